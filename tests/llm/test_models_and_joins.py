"""Operators 2, 6 and 7, components, and the pipeline."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orderscope.llm import hamming_index, jaccard_join, shingles, toxicity
from orderscope.llm.components import components
from orderscope.llm.common import importable
from orderscope.llm.queries import op7_hamming_index
from conftest import SF001


@pytest.fixture(scope="module", autouse=True)
def _package_in_workers(spark):
    importable(spark)

# ---- shingles ----


def _brute_set(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= 5:
        return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("segment", [16, 2 << 20])
def test_shingle_sets(monkeypatch, segment):
    monkeypatch.setattr(shingles, "SEGMENT", segment)
    rng = random.Random(3)
    texts = [None, "", " \n", "a", "A b", "a b c d e", "É é x", "x" * 100 + " y", "a b"]
    texts += [" ".join(rng.choices(["the", "of", "A", "a", "b.", "c\n", "\td"], k=rng.randint(0, 40))) for _ in range(300)]
    flat, sizes = shingles.shingle_sets(texts)
    sets = [frozenset(x.tolist()) for x in np.split(flat, np.cumsum(sizes)[:-1])]
    brute = [_brute_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(b) for b in brute]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    assert all(len(sets[i] & sets[j]) == len(brute[i] & brute[j]) for i, j in rng.sample(pairs, 5000))


# ---- components ----

def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, j) for j in range(501, 600)]
    edges += [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(7, 7), (1, 2), (2, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges for x in (a, b) if a != b}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in linked}
    assert len(got) == len(linked)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 2: Jaccard join ----

def _corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    passage = rng.choices(vocab, k=60)
    texts = []
    while len(texts) < n:
        kind = rng.random()
        words = rng.choices(vocab, k=rng.choice([3, 6, 8, 12, 20, 40, 90, 200]))
        if kind < 0.25 and texts:      # a copy with a few edits, of anything so far
            words = (rng.choice(texts) or "x").split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        elif kind < 0.4:               # a passage that many share
            at = rng.randrange(len(words))
            words[at:at] = passage
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    base = rng.choices(vocab, k=150)   # a large group of near copies, linked in chains
    for _ in range(80):
        words = list(base)
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True)) + [(20_000, None), (20_001, ""), (20_002, " "), (20_003, texts[0])]


def _brute_components(data):
    sets = [(i, _brute_set(t)) for i, t in data]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            shared = len(a & b)
            if shared and 100 * shared >= 75 * (len(a) + len(b) - shared):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("seed, boundary", [(1, None), (2, 0), (3, 50), (4, 4096)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, seed, boundary):
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "choose_boundary", lambda sizes, length: boundary)
    data = _corpus(seed)
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS rep", "3 AS component")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs.repartition(4)).collect()}
    assert got == _brute_components(data)


def test_jaccard_join_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    data = [(None, text), (5, text + " x"), (5, text + " x"), (7, text), (None, "other words here"), (9, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(data)
    assert {r.component_id for r in got if r.doc_id in (5, 7)} == {5}
    assert [r.component_id for r in got if r.doc_id == 9] == [9]
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_rows_without_an_id_or_with_a_repeated_one_are_their_own(spark):
    import corpus_pipeline as pipeline

    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    data = [(5, text(1)), (None, text(1)), (None, text(1) + " more"), (None, text(2)), (None, text(3)), (None, None),
            (9, text(3) + " x"), (9, text(4)), (9, text(1) + " y"), (11, text(4) + " z"), (3, text(5)), (3, text(6)),
            (10, text(6) + " v"), (2, text(7)), (2, text(7)), (1 << 62, text(8)), ((1 << 62) + 1, text(8) + " u"),
            (-4, text(8) + " v")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    rows = jaccard_join.with_node(docs)
    nodes = {r.node: r.text for r in rows.collect()}
    assert len(nodes) == len(data) - 1
    got = sorted(((r.doc_id, nodes[r.node], r.component_id) for r in jaccard_join.row_components(rows).collect()), key=str)
    component = [5, 5, 5, None, 9, None, 9, 9, 5, 9, 3, 3, 3, 2, 2, -4, -4, -4]
    assert got == sorted(((i, t, c) for (i, t), c in zip(data, component, strict=True)), key=str)
    kept = pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    want = [r for r, c in zip(data, component, strict=True) if r[0] == c]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_boundary_follows_cost():
    sizes = [(n, 10) for n in range(1, 500)]
    assert 0 < jaccard_join.choose_boundary(sizes, 0.1) < jaccard_join.choose_boundary(sizes, 5.0)
    assert jaccard_join.choose_boundary([], 1.0) == 0


@pytest.mark.parametrize("boundary", [0, 3, 7, 8, 15, 39, 50])
def test_linked_sets_share_a_key_across_the_boundary(boundary):
    """Without stars: a set inside a larger one, Jaccard 3/4 or just above (sets
    of one element link with equal ones only, which are one set)."""
    rng = np.random.default_rng(boundary)
    for large in range(max(2, boundary - 3), boundary + 30):
        small = int(jaccard_join.needed(large))
        for _ in range(5):
            a = np.unique(rng.integers(0, 1 << 63, large).astype(np.uint64))
            b = np.sort(rng.choice(a, small, replace=False))
            heavy = rng.random(large) < 0.3
            keys = [jaccard_join._keys_of(x, h, boundary) for x, h in ((a, heavy), (b, heavy[np.isin(a, b)]))]
            shared, at_a, at_b = np.intersect1d(*(k >> np.uint64(1) for k in keys), return_indices=True)
            # The smaller set (b) has one of them as the smaller of a pair.
            assert len(shared) and (keys[1][at_b] & np.uint64(1)).any(), (boundary, small, large)


def test_frequent_elements_come_last_however_the_table_is_dealt():
    """A passage in all documents, one document a slice: elements of those that tell are counted over all slices."""
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [f"{passage} " + " ".join(f"d{i}w{k}" for k in range(30)) for i in range(640)]
    batches = (pa.record_batch([pa.array([i]), pa.array([t])], names=["doc", "text"]) for i, t in enumerate(texts))
    told = {}
    for batch in jaccard_join._profile(batches):
        for row in batch.to_pylist():
            if row["element"] is not None:
                told[row["element"]] = told.get(row["element"], 0) + row["told"]
    common = shingles.shingle_sets([passage])[0].view(np.int64).tolist()
    assert {e for e, n in told.items() if n > 1} == set(common) and len({told[e] for e in common}) == 1

    elements = np.arange(1, 101, dtype=np.uint64)
    rank = np.zeros(100, np.int64)
    rank[:90] = np.arange(90, 0, -1)
    assert jaccard_join._prefix(elements, rank, 2).tolist() == [*range(91, 101), *range(90, 73, -1)]


class _NoHeavy:
    value = np.empty(0, np.uint64), np.empty(0, np.int64)


def _met(texts, homes=None, boundary=0):
    n = len(texts)
    batch = pa.record_batch([pa.array(range(n), pa.int64()), pa.array(texts), pa.nulls(n, pa.int64()),
                             pa.array(homes or [None] * n, pa.int64())], names=["doc", "text", "centre", "home"])
    met = {}
    for out in jaccard_join._meet(jaccard_join._write_keys(_NoHeavy, boundary, 3)(iter([batch]))):
        for row in out.to_pylist():
            met[row["a"], row["x"]] = met.get((row["a"], row["x"]), 0) + row["keys"]
    return met


def test_sets_of_far_sizes_do_not_meet_on_a_passage():
    """A passage in short and long texts makes no pair of a short and a long one."""
    passage = " ".join(f"p{k}" for k in range(40))
    sizes = [60, 60, 300, 300, 1200]
    texts = [f"{passage} " + " ".join(f"d{i}w{k}" for k in range(n)) for i, n in enumerate(sizes)]
    assert _met(texts) and all(sizes[a] == sizes[x] for a, x in _met(texts))
    assert not _met(texts, homes=[7] * 5)


@pytest.mark.parametrize("boundary", [0, 30, 400])
def test_linked_sets_meet_whatever_their_sizes(boundary):
    """A text and its beginning, down to just 3/4 of its shingles, meet on all keys they must."""
    rng = random.Random(boundary)
    for n in (8, 20, 39, 40, 41, 127, 128, 129, 255, 256, 260, 515, 1030):
        words = [f"w{rng.random()}" for _ in range(n + 4)]
        small = int(jaccard_join.needed(n))
        for m in {small, small + 1, n - 1}:
            met = _met([" ".join(words), " ".join(words[:m + 4])], boundary=boundary)
            must = 1 if m <= boundary else max(1, m // jaccard_join.TENTH)
            assert met.get((0, 1), 0) >= must, (n, m)


def test_sets_of_a_group_meet_only_if_their_marks_allow_a_link():
    """Texts that have about half of their passages in common share many keys, but of
    the pairs only those that link, and few others, meet."""
    rng = random.Random(7)
    common = [" ".join(f"p{b}w{k}" for k in range(10)) for b in range(10)]
    texts = []
    for i in range(120):
        texts.append(" ".join(p if rng.random() < 0.7 else " ".join(f"d{i}b{b}w{k}" for k in range(10))
                              for b, p in enumerate(common)))
    texts += [t.replace("w5", f"x{i}", 1) for i, t in enumerate(texts[:20])]
    sets = [set(shingles.shingle_sets([t])[0].tolist()) for t in texts]
    links = {(a, x) for x in range(len(sets)) for a in range(x)
             if 100 * len(sets[a] & sets[x]) >= 75 * len(sets[a] | sets[x])}
    met = _met(texts)
    assert len(links) >= 20 and links <= set(met)
    assert len(met) <= len(links) + 0.05 * len(sets) * (len(sets) - 1) / 2


def _met_in_groups(texts, boundary):
    n = len(texts)
    batch = pa.record_batch([pa.array(range(n), pa.int64()), pa.array(texts), pa.nulls(n, pa.int64()),
                             pa.nulls(n, pa.int64())], names=["doc", "text", "centre", "home"])
    met = {}
    for out in jaccard_join._meet(jaccard_join._write_keys(_NoHeavy, boundary, 3, grouped=True)(iter([batch]))):
        for row in out.to_pylist():
            met[row["a"], row["x"]] = met.get((row["a"], row["x"]), 0) + row["keys"]
    return met


def _grown(n_texts, rng):
    """Texts of about 600 words: each ten of them in 0.7 of the texts, else a text's own."""
    common = [" ".join(f"p{b}w{k}" for k in range(10)) for b in range(60)]
    return [" ".join(p if rng.random() < 0.7 else " ".join(f"d{i}b{b}w{k}" for k in range(10))
                     for b, p in enumerate(common)) for i in range(n_texts)]


@pytest.mark.parametrize("boundary", [0, 300])
def test_long_texts_of_a_group_meet_only_if_their_groups_allow_a_link(boundary):
    """Sets beyond MARKED elements, of which half is common: hardly any pair meets but those that link."""
    rng = random.Random(8)
    texts = _grown(60, rng)
    texts += [t.replace("w5", f"x{i}", 3) for i, t in enumerate(texts[:15])]
    texts += [" ".join(t.split()[:int(len(t.split()) * cut)]) for t, cut in zip(texts[15:25], [0.76, 0.9] * 5, strict=True)]
    sets = [set(shingles.shingle_sets([t])[0].tolist()) for t in texts]
    links = {(a, x) for x in range(len(sets)) for a in range(x)
             if 100 * len(sets[a] & sets[x]) >= 75 * len(sets[a] | sets[x])}
    met = _met_in_groups(texts, boundary)
    assert min(map(len, sets)) > jaccard_join.MARKED and len(links) >= 20 and links <= set(met)
    assert len(met) <= len(links) + 0.02 * len(sets) * (len(sets) - 1) / 2


@pytest.mark.parametrize("boundary", [0, 200, 300, 500])
def test_linked_sets_share_a_group_at_the_edges_of_classes(boundary):
    """Differences dealt unevenly, all in some ranges of hash values, on both sides of a class's edge."""
    rng = np.random.default_rng(boundary)
    for larger in (224, 225, 297, 300, 301, 448, 449, 500, 501, 596, 897, 1200):
        for smaller in {int(jaccard_join.needed(larger)), larger - larger // 7, larger - 1}:
            for uneven in (False, True):
                a = np.unique(rng.integers(0, 1 << 64, larger, np.uint64))
                gone = larger - smaller
                drop = rng.integers(0, larger - gone + 1) + np.arange(gone) if uneven else rng.choice(larger, gone, replace=False)
                b = np.delete(a, drop)
                rank = np.where(rng.random(larger) < 0.4, rng.permutation(larger) + 1, 0)
                records = [jaccard_join._keyed(x, r, jaccard_join._marks(x, np.array([len(x)])), boundary, True) for x, r in ((a, rank), (b, np.delete(rank, drop)))]
                shared, at_a, at_b = np.intersect1d(*(k >> np.uint64(1) for k, _, _ in records), return_indices=True)
                met, must = 0, 1 if smaller <= boundary else smaller // jaccard_join.TENTH
                for i, j in zip(at_a, at_b, strict=True):
                    (k, n, m), (l, o, w) = records
                    span, marks = jaccard_join._coarse(np.array([n[i], o[j]])), np.stack([m[:, i], w[:, j]], axis=1)
                    flags = np.array([k[i] & np.uint64(1), l[j] & np.uint64(1)]).astype(bool)
                    if jaccard_join._may_link(np.array([span, span]), marks, flags, np.array([0]), np.array([1])).all():
                        c = int(k[i]) >> 1 & 31
                        met += (jaccard_join.MARKED << c) // jaccard_join.TENTH if c else 1
                assert met >= must, (smaller, larger, uneven)


def test_marks_never_keep_linked_sets_apart():
    rng = np.random.default_rng(3)
    for n in (1, 4, 7, 30, 100, 223, 224, 225, 400):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for keep in {n, n - n // 7, int(jaccard_join.needed(n))}:
            b = np.sort(rng.choice(a, keep, replace=False))
            sizes = np.array([len(a), len(b)])
            marks = jaccard_join._marks(np.concatenate([a, b]), sizes)
            span = jaccard_join._coarse(sizes)
            assert jaccard_join._may_link(np.array([span, span]), marks, np.array([True, True]),
                                          np.array([0]), np.array([1])).all(), (n, keep)


def test_sets_of_one_centre_with_other_marks_meet_what_any_of_them_links_with():
    base = [f"w{k}" for k in range(60)]
    other = [*base[:40], *(f"v{k}" for k in range(14))]
    texts = [" ".join(base), " ".join(other), " ".join([*other[:-1], "u"])]
    batch = pa.record_batch([pa.array([0, 1, 2]), pa.array(texts), pa.array([0, 0, None], pa.int64()),
                             pa.nulls(3, pa.int64())], names=["doc", "text", "centre", "home"])
    met = [(r["a"], r["x"]) for out in jaccard_join._meet(jaccard_join._write_keys(_NoHeavy, 0, 3)(iter([batch])))
           for r in out.to_pylist()]
    assert set(met) == {(0, 2)}


def test_coarse_sizes_bound_the_exact_ones():
    n = np.unique(np.concatenate([np.arange(1, 70_000), 1 << np.arange(40), (1 << np.arange(1, 40)) - 1]))
    coarse = jaccard_join._coarse(n)
    least, most = jaccard_join._least_of(coarse), jaccard_join._most_of(coarse)
    assert ((least <= n) & (n <= most)).all() and (most[n < 256] == n[n < 256]).all()
    assert (most <= least * 1.008 + 1).all()


def test_texts_with_a_common_passage_propose_no_stars(spark, monkeypatch):
    """Only sets that share two sketch values are held against a centre whole."""
    proposed = []

    def seen(df, name, *more, spill=jaccard_join.spill):
        out = spill(df, name, *more)
        if name == "jaccard-proposed":
            proposed.append(out.count())
        return out
    monkeypatch.setattr(jaccard_join, "spill", seen)
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(i, f"{passage} " + " ".join(f"d{i}w{k}" for k in range(140))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert found == {i: i % 100 for i, _ in rows}
    assert proposed[0] <= 60     # one sketch value is enough for 84


# ---- 6: toxicity ----

@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    words = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    stems = ["vile", "nasty", "grim"]

    def text(toxic):
        out = rng.choices(words, k=rng.randint(5, 80))
        for _ in range(rng.randint(2, 6) if toxic else 0):
            out.insert(rng.randrange(len(out)), rng.choice(stems) + rng.choice(["", "er", "ness", "abc", "xyz"]))
        return " ".join(out).title() + "."
    data = [(i, text(i % 8 == 0), int(i % 8 == 0)) for i in range(1600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i < 800] + [(None, 1), (3, None), (99_999, 1)],
                                   "doc_id long, toxic int")
    return docs, labels, {i: y for i, _, y in data}


def test_toxicity_on_held_out_documents(spark, labelled):
    docs, labels, truth = labelled
    model = toxicity.fit_model(docs, labels)
    assert (np.diff(model.thresholds) >= 0).all()
    rows = toxicity.score(docs.withColumn("grade", F.lit("x")), model).filter("doc_id >= 800").collect()
    wrong = [r.doc_id for r in rows if r.toxic != bool(truth[r.doc_id])]
    assert len(wrong) <= 0.01 * len(rows)
    mean = lambda g: np.mean([r.expected_severity for r in rows if r.grade == g])
    assert mean(0) < 0.2 < mean(1) < mean(2)


def test_toxicity_odd_rows(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.fit_model(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (None, "VILENESS nasty grim vile"), (4, "plain " * 50_000)],
                                "doc_id long, text string")
    got = {r.doc_id: r.toxic for r in toxicity.score(odd, model).collect()}
    assert got == {1: False, 2: False, 3: False, None: True, 4: False}
    assert toxicity.score(odd.limit(0), model).count() == 0
    nothing = toxicity.fit_model(docs, labels.filter("toxic = 0"))
    assert toxicity.score(odd, nothing).filter("toxic").count() == 0
    assert toxicity.fit_model(docs, labels.limit(0)).words == []


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    margin, grade, t = rng.normal(size=50), rng.integers(0, 3, 50), np.array([-0.5, 0.7])
    d_margin, d_t = toxicity._gradients(margin, grade, t)
    step = 1e-6
    for i in range(5):
        e = np.eye(50)[i] * step
        slope = (toxicity._loss(margin + e, grade, t) - toxicity._loss(margin - e, grade, t)) / (2 * step)
        assert abs(slope - d_margin[i]) < 1e-6
    for j in range(2):
        e = np.eye(2)[j] * step
        slope = (toxicity._loss(margin, grade, t + e) - toxicity._loss(margin, grade, t - e)) / (2 * step)
        assert abs(slope - d_t[j]) < 1e-6


# ---- 7: nearest neighbours ----

def _brute_nearest(ids, vectors, query, k):
    v = vectors[ids.index(query)]
    found = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in zip(ids, vectors, strict=True) if i != query)
    return [i for _, i in found[:k]]


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet(f"{SF001}/embeddings.parquet").toPandas()
    ids, vectors = table.vec_id.tolist(), [np.asarray(v, float) for v in table.embedding]
    got = op7_hamming_index(spark, SF001).toPandas()
    hits = [len(set(_brute_nearest(ids, vectors, q, 10)) & set(g.vec_id)) / 10 for q, g in got.groupby("query_id")]
    assert np.mean(hits) >= 0.9 and len(hits) == sum(i % 100 == 0 for i in ids)
    one = got[got.query_id == 0].sort_values("rank")
    assert one["rank"].tolist() == list(range(1, 11)) and one.score.is_monotonic_increasing


def test_nearest_odd_rows_and_copies(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=16).tolist() for _ in range(40)]
    data = [(i, v) for i, v in enumerate(vectors)] + [(100 + i, vectors[0]) for i in range(300)]
    data += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 15), (904, [None] * 16),
             (905, [float("inf")] + [1.0] * 15), (None, vectors[1]), (7, vectors[7])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "1 AS key", "2 AS ids")
    got = {}
    for r in hamming_index.nearest(df, F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {*range(0, 40, 10), *range(100, 400, 10)}
    assert got[0] == [(100 + i, 0.0) for i in range(5)]
    assert got[100] == [(0, 0.0), (101, 0.0), (102, 0.0), (103, 0.0), (104, 0.0)]
    assert hamming_index.nearest(df.limit(0), F.lit(True)).count() == 0
    few = df.filter("vec_id < 4")
    assert hamming_index.nearest(few, F.lit(True), k=10).count() == 12


@pytest.mark.parametrize("radius", [0, 5, 7, 12, 20, 64])
def test_probing_finds_every_code_within_the_radius(radius):
    rng = np.random.default_rng(2)
    entries, queries = rng.normal(size=(400, 64)), rng.normal(size=(20, 64))
    codes = hamming_index.Codes(np.zeros(64), np.eye(64), radius)
    apart = hamming_index.BITS[codes.encode(entries)[None] ^ codes.encode(queries)[:, None]].sum(axis=2)
    q, e, _ = hamming_index.search_cell(codes, entries, np.arange(400), queries, 400)
    assert sorted(zip(q.tolist(), e.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(apart <= radius).tolist()))


# ---- the pipeline ----

def test_pipeline_on_the_small_corpus(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.spill(stage(spark, docs, SF001), f"test-{name}")
        seen[name] = docs
        if name != "sentencepiece":
            assert docs.columns == columns
    labels = spark.read.parquet(f"{SF001}/labels.parquet").collect()
    kept = {r.doc_id for r in seen["toxicity"].collect()}
    clean, toxic = ({r.doc_id for r in labels if r.toxic == t} for t in (0, 1))
    assert len(clean - kept) <= 0.02 * len(clean) and len(toxic - kept) >= 0.5 * len(toxic)

    lines, near = seen["line_dedup"], seen["jaccard_join"]
    data = [(r.doc_id, r.text) for r in lines.collect()]
    groups = _brute_components(data)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in groups.items() if c == i}

    assert {r.doc_id for r in seen["mixing"].collect()} == {r.doc_id for r in near.collect()}
    texts = {r.doc_id: r.text for r in near.collect()}
    last = seen["sentencepiece"].collect()
    assert all(r.text == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in last)

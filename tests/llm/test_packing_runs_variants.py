"""Operators 11 to 13: odd rows, brute force, invariants of packing."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF0001
from orderscope.llm import packing, periodic_runs, queries, spelling_variants
from orderscope.llm.common import importable
from orderscope.llm.queries import tokenizer_path


@pytest.fixture(scope="module", autouse=True)
def _package_in_workers(spark):
    importable(spark)


# ---- 11: packing ----

def _power(n):
    return n & (n - 1) == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=60), st.sampled_from([64, 128, 256]), st.sampled_from([8, 16, 64]))
def test_pack_holds_every_token_once_and_pads_nothing(lengths, window, shortest):
    sequences = packing.pack(lengths, window, shortest)
    seen = [np.zeros(n, int) for n in lengths]
    for row in sequences:
        total = sum(n for _, _, n in row)
        assert 0 < total <= window and _power(total)
        for doc, start, n in row:
            assert n > 0
            seen[doc][start:start + n] += 1
            assert start + n <= lengths[doc]
    assert all((s == 1).all() for s in seen)
    # Only the sequence in which the documents run out is shorter than a tier.
    assert sum(sum(n for _, _, n in row) not in packing.tiers(window, shortest) for row in sequences) <= 12


def test_pack_prefers_whole_documents_from_shorter_tiers():
    # 1500 opens a window; of the rest 400 and then 148 fill it without a cut.
    sequences = packing.pack([148, 1500, 400], 2048)
    assert sequences == [[(1, 0, 1500), (2, 0, 400), (0, 0, 148)]]
    assert packing.pack([5000], 2048) == [[(0, 0, 2048)], [(0, 2048, 2048)], [(0, 4096, 512)], [(0, 4608, 256)],
                                          [(0, 4864, 128)], [(0, 4992, 8)]]
    assert packing.pack([], 2048) == []


def test_balance_deals_cost():
    rng = random.Random(4)
    sequences = packing.pack([rng.randint(1, 3000) for _ in range(3000)], 2048)
    groups = packing.balance(sequences, 64 * 2048)
    cost = Counter()
    for g, row in zip(groups, sequences):
        cost[g] += sum(n * n for _, _, n in row)
    assert len(cost) > 20 and max(cost.values()) - min(cost.values()) <= 2048 ** 2


PACK = [(1, "a b c", "x"), (2, None, "y"), (None, "", "z"), (3, "word " * 9000, None), (3, "word", "z"),
        (None, "Die Straße, 12.5 <|endoftext|> x", "z"), (4, " \n ", "z")]


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = spark.createDataFrame(PACK, "doc_id long, text string, ids string").selectExpr("*", "1 AS offset")
    rows = packing.pack_documents(docs.coalesce(1), tokenizer_path("word_bpe_49k.json"), end_id=1,
                                  special_in_text=True).collect()
    want = Counter()
    for i, text, _ in PACK:
        want[i, tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    # Rows that share an id are told apart by their number of tokens here.
    got = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"]
        got[r["doc_id"], r["doc_tokens"]].append((r["start"], ids.tolist()))
    joined = Counter()
    for (i, n), pieces in got.items():
        copies = sum(s == 0 for s, _ in pieces)
        ids = [x for _, p in sorted(pieces) for x in p]
        assert len(ids) == n * copies
        joined[i, tuple(ids[:n])] += copies
    assert joined == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_tokens"], r["step_group"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length, total, group in sorted(pieces):
            assert offset == at
            at += length
        assert at == total <= 2048 and _power(at) and len({p[3] for p in pieces}) == 1


def test_words_have_one_table_that_holds_twice_as_many():
    """Distinct words are looked up once, in a table with the room of the two before."""
    from tokenizers import Tokenizer

    from orderscope.llm import token_files, words

    path = tokenizer_path("word_bpe_49k.json")
    table, dtype = token_files.encoder(path)
    assert table._max == 2 * words.MAX_TABLE
    tokenizer = Tokenizer.from_file(path)
    texts = ["stem stem. stem, Stem, . , .. a., \u00e9t\u00e9. \ufb01n, 3. x,", "", "<|endoftext|>. ok, <|endoftext|>"]
    ids, lengths = token_files.WordIds(token_files._word_encoder(path)[0], dtype).texts(
        token_files.split_words(texts, token_files.special_pattern(path)))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_pack_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1).count() == 0


def test_packing_query_over_a_table(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    rows = queries.op11_packing(spark, SF0001).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() == docs.keys()
    for i, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


# ---- 12: spelling variants ----

def _near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def _brute_groups(counts, factor=10):
    form, near = {}, {}
    for w, n in counts.items():
        near[w] = [v for v in counts if _near(w, v)]
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def _groups(spark, counts, **options):
    df = spark.createDataFrame(list(counts.items()), "word string, n long").selectExpr("*", "1 AS root", "2 AS node")
    got = spelling_variants.variant_groups(df, **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_variants_of_random_words(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("aabé", k=rng.randint(5, 9))) for _ in range(500)}
    counts = {w: 2 + int(rng.random() ** 8 * 5000) for w in words}
    assert _groups(spark, counts) == _brute_groups(counts)


def test_variants_follow_forms_break_ties_and_mind_runs_of_letters(spark):
    counts = {"letters": 2000, "lettters": 150, "letttters": 9, "lettrs": 2, "better": 7, "abcdefg": 30, "abcdefh": 30,
              "abcdef": 3, "aaaaaaa": 5, "aaaaaaaa": 5, "aaaaaaaaa": 50, "zbcdefg": 3, "ébcdefg": 3, "×bcdefg": 3, "x": 2,
              "xy": 40, "y": 40}
    assert _groups(spark, counts) == _brute_groups(counts)


def test_variants_of_long_words(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abc", k=n)) for n in (6, 7, 8, 9, 40, 200)] + ["a" * 150, "a" * 151]
    counts = {}
    for w in base:
        counts[w] = 100
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice("abcd")
            for v in (w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]):
                counts.setdefault(v, rng.randint(1, 30))
    # Words of 7 letters and less go through the trie, longer ones by hashes.
    assert _groups(spark, counts, longest=7) == _brute_groups(counts)
    assert _groups(spark, counts) == _brute_groups(counts)


def test_variants_of_one_hot_prefix(spark):
    counts = {f"international{i:04d}".translate(str.maketrans("0123456789", "abcdefghij")): 2 for i in range(400)}
    assert _groups(spark, counts) == _brute_groups(counts)


def test_variants_whose_nodes_share_keys(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "_key", lambda node: F.xxhash64(node) % 5)
    rng = random.Random(4)
    counts = {"".join(rng.choices("aabé", k=rng.randint(5, 8))): rng.randint(2, 90) for _ in range(60)}
    assert _groups(spark, counts) == _brute_groups(counts)


def test_nodes_begin_where_states_do(spark):
    marked = spark.createDataFrame([(">abcdefg",), (">abcdefghijklm",)], "t string")
    got = {(r.depth, r.node): (sorted(r.letters), r.ends) for r in spelling_variants._nodes(marked).collect()}
    assert got[4, ">abc"] == (["d"], False) and got[7, ">abcdef"] == (["g"], False)
    assert got[8, ">abcdefg"] == (["h"], True) and got[14, ">abcdefghijklm"] == ([], True)
    assert min(d for d, _ in got) == 4 and len(got) == 11
    alone = spelling_variants._nodes(marked.filter("length(t) > 10")).collect()
    assert min(r.depth for r in alone) == 7


def test_no_variants(spark):
    assert _groups(spark, {}) == []
    assert _groups(spark, {"alone": 3}) == [("alone", None, "alone", 3, 0, None)]
    odd = spark.createDataFrame([(None, 3), ("", 4), ("word", 5)], "word string, n long")
    assert [tuple(r) for r in spelling_variants.variant_groups(odd).collect()] == [("word", None, "word", 5, 0, None)]
    with pytest.raises(ValueError):
        spelling_variants.variant_groups(odd, factor=1)


def test_counted_words(spark):
    docs = spark.createDataFrame([("Straßenbahn, STRAßENBAHN Ähnlichähnlich x1", 1), (None, 2), ("", 3),
                                  ("abcdefg-abcdefg abcdef Ÿabcdefg", 4), ("z" * 100_000 + " " + "z" * 100_000, 5)],
                                 "text string, word int")
    words = docs.select(spelling_variants.runs_of(docs.text, 7).alias("w")).selectExpr("explode(w) AS word")
    got = {r["word"]: r["n"] for r in spelling_variants.count_words(words).collect()}
    assert got == {"straßenbahn": 2, "abcdefg": 3, "z" * 100_000: 2}


# ---- 13: periodic runs ----

def _brute_runs(words, least):
    n, found = len(words), []
    covered = defaultdict(list)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                length = j + q - i
                if length >= max(least, 2 * q) and not any(a <= i and j + q <= b for p in covered if q % p == 0
                                                           for a, b in covered[p]):
                    found.append((i, length, q))
                    covered[q].append((i, j + q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _brute_collapse(words, runs):
    gone = set()
    for start, length, period in runs:
        gone.update(range(start + period, start + length))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([2, 4, 7, 12]))
def test_runs_of_random_words(symbols, least):
    docs, runs = periodic_runs.find_runs(np.array(symbols, np.int64), np.array([len(symbols)]), least)
    assert [tuple(r) for r in runs.tolist()] == _brute_runs(symbols, least)


def test_runs_of_structured_words():
    rng = random.Random(5)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 200:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    cases = [fibonacci[-1], [0] * 150, [0, 1] * 80 + [2] + [0, 1] * 80, list(range(300)), list(range(40)) * 5,
             [*range(30), 7, *range(30), 7, *range(30)]]
    for _ in range(60):
        case = []
        for _ in range(rng.randint(1, 5)):
            unit = [rng.randint(0, 9) for _ in range(rng.randint(1, 12))]
            case += unit * rng.randint(1, 5) + [rng.randint(0, 9) for _ in range(rng.randint(0, 4))]
        cases.append(case)
    codes = np.array([c for case in cases for c in case], np.int64)
    docs, runs = periodic_runs.find_runs(codes, np.array(list(map(len, cases))), 12)
    for d, case in enumerate(cases):
        assert [tuple(r) for r in runs[docs == d].tolist()] == _brute_runs(case, 12), d


def test_common_prefixes():
    rng = random.Random(6)
    s = [rng.randint(0, 1) for _ in range(300)] + [0] * 100
    tree = periodic_runs.SuffixTree(s)
    common = tree.common_prefixes()
    i, j = np.array([(rng.randrange(401), rng.randrange(401)) for _ in range(3000)]).T
    i, j = i[i != j], j[i != j]
    want = []
    for a, b in zip(i.tolist(), j.tolist()):
        k = 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        want.append(k)
    assert common(i, j).tolist() == want
    order = sorted(range(401), key=lambda k: s[k:])
    assert [r for r in np.argsort(tree.leaf_ranks(True)).tolist()] == order


RUN_DOCS = [(1, "a b " * 10 + "c", 1), (2, None, 2), (None, "", 3), (3, " \t\x0b x \n", 4), (3, "x " * 50_000, 5),
            (4, " ".join(map(str, range(500))), 6), (5, "  " * 14 + "A a " * 6, 7), (5, "  " * 14 + "A a " * 6, 7),
            (6, "line one is here\n" * 3, 8)]


def test_periodic_runs_of_odd_rows(spark):
    docs = spark.createDataFrame(RUN_DOCS, "doc_id long, text string, runs int").selectExpr("*", "1 AS start", "2 AS h")
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "start", "h", "n_words", "runs", "collapsed"]
    want = []
    for i, text, _ in RUN_DOCS:
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
        runs = [(0, 50_000, 1)] if len(words) == 50_000 else _brute_runs(words, 12)
        want.append((i, len(words), tuple(runs), _brute_collapse(words, runs)))
    rows = [(r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_runs_query(spark):
    want = {}
    for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect():
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in r["text"] or "").split(" ") if w]
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 3000:    # the brute force is quadratic
            continue
        runs = _brute_runs(words, 12)
        text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        want[r["doc_id"]] = (len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                             hashlib.sha256(text.encode()).hexdigest(),
                             hashlib.sha256(_brute_collapse(words, runs).encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF0001).collect()}
    assert len(got) == 200 and len(want) > 150 and sum(v[0] > 0 for v in want.values()) > 10
    assert {k: got[k] for k in want} == want

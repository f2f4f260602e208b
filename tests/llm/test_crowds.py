"""Crowds of near copies: links by differences from what they have in common."""

from __future__ import annotations

import random

import pytest

from orderscope.llm import crowds, jaccard_join


def _components(data):
    sets, parent = [], {}
    for i, text in data:
        words = (text or "").split()
        sets.append((i, {tuple(words[k:k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if find(i) != find(j):
                shared = len(a & b)
                if shared and 100 * shared >= 75 * (len(a) + len(b) - shared):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def _crowd(seed, copies, edits):
    """Copies of two texts with up to ``edits`` words replaced, some replacements
    and some whole edits shared, and a chain of texts that move on word by word."""
    rng = random.Random(seed)
    data = []
    for g in range(2):
        base = [f"g{g}w{k}" for k in range(150)]
        common = [(rng.randrange(150), f"shared{k}") for k in range(12)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(edits)):
                at, word = rng.choice(common) if rng.random() < 0.5 else (rng.randrange(150), f"own{rng.random()}")
                words[at] = word
            data.append(words[rng.randrange(20) * (rng.random() < 0.2):])
    chain = [f"c{k}" for k in range(400)]
    data += [chain[k:k + 100] for k in range(0, 300, 9)]
    rng.shuffle(data)
    return [(i, " ".join(words)) for i, words in enumerate(data)]


@pytest.mark.parametrize("by_stars", [True, False])
def test_crowds_equal_brute_force(spark, monkeypatch, by_stars):
    """Crowds found by their stars, or only by the pairs that keys bring together."""
    settled = []

    def seen(docs, held, settle=crowds.settle):
        links = settle(docs, held)
        settled.append(links.count())
        return links
    monkeypatch.setattr(crowds, "LEAST_MEMBERS", 4)
    monkeypatch.setattr(crowds, "LEAST_PAIRS", 0)
    monkeypatch.setattr(crowds, "settle", seen)
    monkeypatch.setattr(jaccard_join, "settle", seen)
    if not by_stars:
        monkeypatch.setattr(jaccard_join, "star_homes", lambda pairs, known, stars: crowds.star_homes(
            pairs, known, stars).limit(0))
    data = _crowd(1, 200, 20)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == _components(data)
    assert any(settled)


def test_pairs_are_left_alone_without_a_crowd(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g")], "doc long, text string")
    pairs = spark.createDataFrame([(1, 2)], "a long, x long")
    known = spark.createDataFrame([(1, 1)], "node long, component long")
    stars = spark.createDataFrame([], "doc long, centre long, d double")
    assert crowds.crowd_links(docs, pairs, known, stars) is None


def test_sets_of_a_crowd_by_hand(spark, monkeypatch):
    """Members with repeated rows, an outsider that links to one edited member only,
    and one that links to none."""
    monkeypatch.setattr(crowds, "LEAST_PAIRS", 0)
    words = [f"w{k}" for k in range(100)]
    edit = lambda *spans: " ".join("z" + w if any(a <= k < b for a, b in spans) else w for k, w in enumerate(words))
    texts = {i: edit((i, i + 1)) for i in range(20)} | {50: edit((60, 67)), 51: edit((60, 74)), 52: edit((30, 55))}
    docs = spark.createDataFrame([*texts.items(), (3, texts[3])], "doc long, text string")
    known = spark.createDataFrame([(i, 0) for i in range(20)], "node long, component long")
    pairs = spark.createDataFrame([(1, 50), (2, 51), (3, 52), (50, 51), (900, 901)], "a long, x long")
    stars = spark.createDataFrame([(i, i % 5, 0.1) for i in range(5, 20)], "doc long, centre long, d double")
    links, left = crowds.crowd_links(docs, pairs, known, stars)
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(96)} for i, t in texts.items()}
    found = {(r.a, r.x) for r in links.collect()}
    for a, x in found:
        assert 4 * len(sets[a] & sets[x]) >= 3 * len(sets[a] | sets[x])
    assert any(50 in p for p in found) and (50, 51) in found
    assert not any(52 in p for p in found)
    assert [tuple(r) for r in left.collect()] == [(900, 901)]


def test_sets_meet_on_rarest_elements_of_both(spark):
    """Every pair that shares enough meets, from the side with more excess alone."""
    rng = random.Random(5)
    sets = {d: (rng.randint(-20, 90), set(rng.sample(range(40), rng.randint(4, 25)))) for d in range(120)}
    sets |= {200 + d: (60, set(range(100, 130))) for d in range(30)}
    times = {}
    for _, elements in sets.values():
        for e in elements:
            times[e] = times.get(e, 0) + 1
    least = min(e for e, _ in sets.values())
    rows = [(7, d, e, len(x), max(0, -(-(e + least) // 14)), sorted((times[v], v) for v in x)) for d, (e, x) in sets.items()]
    rare = spark.createDataFrame(rows, "home long, doc long, excess long, s int, need long, "
                                       "rare array<struct<times:long,element:long>>").filter("s >= need")
    met = crowds.rare_meetings(rare).collect()
    pairs = {tuple(sorted((r.p, r.doc))) for r in met}
    for a, (e, x) in sets.items():
        for b, (f, y) in sets.items():
            if a < b and e + f > e + least > 0 and f + least > 0 and 14 * len(x & y) >= e + f:
                assert (a, b) in pairs
    assert all((r.p_excess, r.p) > (r.excess, r.doc) for r in met)
    # Thirty equal sets of 30 elements that must share 9 meet on 30 - 9 + 1 at most, once a pair.
    assert sum(r.p >= 200 and r.doc >= 200 for r in met) == 30 * 29 // 2 * 22

"""Operators 3, 5, 8 and 9: odd rows, brute force, exact round trips."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderscope.llm import chat_format, line_dedup, mixing, sentencepiece_bpe
from orderscope.llm.common import importable
from orderscope.llm.queries import tokenizer_path


@pytest.fixture(scope="module", autouse=True)
def _package_in_workers(spark):
    importable(spark)

# ---- 3: budgets whatever the ids ----

@pytest.mark.parametrize("ids", ["missing", "repeated", "equal rows"])
def test_mix_meets_its_budget_with_odd_ids(spark, ids):
    docs = spark.range(3000).selectExpr(
        {"missing": "if(id % 3 = 0, id, null)", "repeated": "if(id % 3 = 0, 7, id)",
         "equal rows": "if(id % 3 = 0, id, null)"}[ids] + " AS doc_id",
        "if(id % 2 = 0, 'a', 'b') AS source", "1 AS who", "2 AS row", "3 AS alike",
        ("if(id % 3 = 0, concat('t', id), 'same words in all') AS text" if ids == "equal rows"
         else "concat('t', id, repeat(' x', cast(id % 9 AS int))) AS text"))
    total = docs.select(mixing.word_count(docs.text).alias("n")).groupBy().sum("n").first()[0]
    for budget in (total // 3, total, 2 * total + 100):
        mixed = mixing.mix(docs, max_repeats=1.0, budget=budget, block_tokens=500).withColumn("n", mixing.word_count(F.col("text")))
        got = mixed.groupBy().sum("n").first()[0]
        assert budget <= got + 2 and got <= budget + 2 * 10, (budget, got)
        # No place holds more than the rows that are visited there.
        assert mixed.groupBy("source", "mix_epoch", "mix_order").count().filter("count > 1").count() == 0
        blocks = mixed.groupBy("source", "mix_epoch", "mix_block").sum("n").toPandas()["sum(n)"]
        assert blocks.max() <= 1500


# ---- 8: SentencePiece ----

MODEL = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a", " a ", "\x00a b", "the the the  the", "a" * 4000, "    " * 9 + "x", "é🙂 漢字 \n\n x",
         "▁a ▁", "▁▁ ▁", "</s> <unk> <0x41>", "tab\tand\r\nline", "word " * 20_000, "x" * 30 + " " * 30 + "x" * 30]


def _library():
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=MODEL)


def _same(texts):
    sp = _library()
    ids, lengths = sentencepiece_bpe.encode_texts(MODEL, texts)
    want = [[*x, sp.eos_id()] for x in sp.encode(texts)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    assert sentencepiece_bpe.model(MODEL)[0].decode(ids, lengths) == [sp.decode(x) for x in want]


def test_pieces_equal_the_library():
    rng = random.Random(1)
    alphabet = "ab cde  \n\t.éüñßA1🙂▁漢字'<s></s>"
    _same(TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(2000)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_pieces_equal_the_library_on_any_text(texts):
    _same(texts)


def test_encode_and_decode_in_one_step(spark, monkeypatch):
    from orderscope.llm import words
    monkeypatch.setattr(sentencepiece_bpe, "SLICE_BYTES", 50)
    texts = [*TEXTS, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS ids", "'t' AS lang")
    got = sentencepiece_bpe.encode_and_decode(docs, MODEL)
    assert got.columns == ["doc_id", "lang", "ids", "text"]
    sp = _library()
    for r in got.collect():
        ids = [*sp.encode(texts[r["doc_id"]] or ""), sp.eos_id()]
        assert r["ids"] == ids and r["text"] == sp.decode(ids)
    assert sentencepiece_bpe.encode_and_decode(docs.limit(0), MODEL).count() == 0
    # A table that starts anew between slices gives the same ids.
    bpe = sentencepiece_bpe.model(MODEL)[0]
    small = words.WordIds(bpe.encode_words, np.int32, max_bytes=200)
    for text in ["one two three", "two four", "one five two", "three one"] * 3:
        assert small.texts(sentencepiece_bpe.split_words([text]))[0].tolist() == sp.encode(text)


def test_encode_and_decode_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (2, None, 8), (None, "  x ", 9)], "doc_id long, text string, ids int")
    encoded = sentencepiece_bpe.encode(docs, MODEL)
    assert encoded.columns == ["doc_id", "text", "ids"]
    decoded = sentencepiece_bpe.decode(encoded.drop("text"), MODEL).collect()
    assert sorted(((r.doc_id, r.text) for r in decoded), key=str) == [(1, "a b"), (2, ""), (None, "  x ")]
    assert sentencepiece_bpe.encode(docs.limit(0), MODEL).count() == 0
    digests = sentencepiece_bpe.round_trip_digests(docs, MODEL).filter("doc_id = 2").first()
    assert (digests.n_tokens, digests.ids_sha256) == (1, hashlib.sha256(b"2").hexdigest())
    assert digests.decoded_sha256 == hashlib.sha256(b"").hexdigest()


# ---- 5: chat ----

CHAT = [(1, 0, "user", "hi \\s \\c [INST]"), (1, 1, "assistant", "</s>yes<s>"), (1, 2, "user", None),
        (1, 3, "assistant", ""), (1, 3, "assistant", "tie"), (2, 0, "assistant", "<<SYS>><</SYS>>\\"),
        (3, None, "user", "no turn"), (3, 0, "system", "s"), (3, 1, "t<ool>[/INST]", "out"), (3, 2, None, "none"),
        (None, 0, "user", "no conversation"), (4, 0, "user", "only a question"), (1, 5000, "assistant", "late")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS seq", "'x' AS segment", "2 AS block", "3 AS start")
    turns, examples = chat_format.write_examples(df.repartition(3))
    got = {r.conv_id: r for r in chat_format.conversation_digests(turns, examples).collect()}
    by_conv = {}
    for c, t, role, text in sorted(CHAT, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by_conv.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, lines in by_conv.items():
        loss = "".join(t for r, t in lines if r == "assistant")
        assert got[c].n_turns == len(lines)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in lines).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert examples.count() == sum(r == "assistant" for _, _, r, _ in CHAT)

    texts = {(r.conv_id, r.target_seq): r.text for r in chat_format.example_texts(turns, examples).collect()}
    for e in examples.collect():
        text = texts[e.conv_id, e.target_seq]
        assert text == text[:e.context_chars] + e.reply and text.endswith(" </s>")
        reply = text[e.loss_start:e.loss_end]
        assert not any(c in reply for c in chat_format.CONTROLS)
    assert chat_format.format_turns(df.limit(0)).count() == 0


def test_chat_examples_hold_their_whole_context(spark):
    # Turns of a conversation longer than a stretch, one without replies at its end, one without an id.
    data = [(1, t, "assistant" if t % 3 else "user", f"<s>é{t}") for t in range(2 * chat_format.TURNS_PER_STRETCH + 40)]
    data += [(1, t, "user", "more") for t in range(10_000, 10_300)]
    data += [(None, 0, "user", "q"), (None, 1, "assistant", None), (2, 0, "user", "alone"), *CHAT[:6]]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    turns, examples = chat_format.write_examples(df.repartition(4))
    segments = {}
    for r in sorted(turns.collect(), key=lambda r: r.seq):
        segments.setdefault(r.conv_id, []).append(r)
    got = examples.collect()
    assert {(e.conv_id, e.target_seq) for e in got} == {
        (c, r.seq) for c, rows in segments.items() for r in rows if r.trainable}
    assert len(got) == sum(r == "assistant" for _, _, r, _ in data)
    for e in got:
        before = [r.segment for r in segments[e.conv_id][:e.target_seq - 1]]
        assert (e.context, e.context_turns, e.context_chars) == ("".join(before), len(before), len("".join(before)))
        assert e.reply == segments[e.conv_id][e.target_seq - 1].segment
        assert (e.context + e.reply)[e.loss_start:e.loss_end] == e.reply[1:-5]


def test_escape_is_reversible(spark):
    rng = random.Random(2)
    parts = [*chat_format.CONTROLS, "\\", "s", "c", "<", "[", "]", ">", "\\s", "\\c", "x"]
    data = [("".join(rng.choices(parts, k=rng.randint(0, 12))),) for _ in range(3000)]
    df = spark.createDataFrame(data, "t string")
    out = df.select("t", chat_format.escape(df.t).alias("e")).withColumn("u", chat_format.unescape("e"))
    for r in out.collect():
        assert r.t == r.u and not any(c in r.e for c in chat_format.CONTROLS)


# ---- 3: mixing ----

def _mix_docs(spark):
    rng = random.Random(3)
    data = [(i, "hot" if i % 3 else None if i % 2 else f"s{i % 5}", " ".join("w" * rng.randint(0, 30))) for i in range(600)]
    data += [(None, "hot", "no id"), (5, "hot", "same id"), (5, "hot", "same id, other text"), (601, "empty", ""), (602, "empty", None)]
    return spark.createDataFrame(data, "doc_id long, source string, text string").selectExpr(
        "*", "1 AS tokens", "2 AS block", "3 AS mix_epoch", "'k' AS skey"), data


def _h(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:15], 16)


def _brute_mix(data, block_tokens, exponent, budget=None):
    words = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    sources = {}
    for i, s, t in data:
        sources.setdefault(s, []).append((i, words(t), t))
    totals = {s: sum(n for _, n, _ in v) for s, v in sources.items()}
    weight = {s: (n / sum(totals.values())) ** exponent for s, n in totals.items() if n}
    q = {s: w / sum(weight.values()) for s, w in weight.items()}
    words_all = budget if budget is not None else max(totals[s] / q[s] for s in q)
    ids = [i for i, _, _ in data]

    def name(i, t):
        """Ids that are missing or repeated go with their text."""
        if i is not None and ids.count(i) == 1:
            return str(i)
        return f"{'null' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()}"
    out = []
    for s, rows in sources.items():
        key = "n" if s is None else "s" + s
        goal = round(words_all * q[s]) if s in q else 0
        epochs, rest = divmod(goal, totals[s]) if totals[s] else (1, 0)
        n_blocks = max(1, math.ceil(totals[s] / block_tokens))
        blocks = {}
        for i, n, t in rows:
            blocks.setdefault(_h("17", "block", name(i, t)) % n_blocks, []).append((i, n, t))
        for e in range(epochs):
            for b, docs in blocks.items():
                out += [(i, s, e, _h("17", "pass", str(e), key, str(b)), _h("17", "doc", str(e), name(i, t))) for i, _, t in docs]
        for place, b in sorted((_h("17", "pass", str(epochs), key, str(b)), b) for b in blocks):
            docs = sorted((_h("17", "doc", str(epochs), name(i, t)), n, i) for i, n, t in blocks[b])
            before, cut = 0, None
            for o, n, _ in docs:
                if before < rest:
                    cut = o
                before += n
            out += [(i, s, epochs, place, o) for o, n, i in docs if cut is not None and o <= cut]
            rest = max(0, rest - before)
    return sorted(out, key=str)


def _exponent(data, reached):
    return next(k for k in range(10_001) if reached(k / 10_000)) / 10_000


@pytest.mark.parametrize("block_tokens", [40, 4_000_000])
@pytest.mark.parametrize("repeats", [1.0, 1.5, 3.0])
def test_mixing_equals_brute_force(spark, block_tokens, repeats):
    docs, data = _mix_docs(spark)
    mixed = mixing.mix(docs.repartition(4), max_repeats=repeats, block_tokens=block_tokens)
    words = {}
    for _, s, t in data:
        words[s] = words.get(s, 0) + len((t or "").split())
    p = [n / sum(words.values()) for n in words.values() if n]
    exponent = _exponent(data, lambda a: (max(p) / min(p)) ** (1 - a) <= repeats)
    got = sorted((tuple(r) for r in mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_order").collect()),
                 key=str)
    assert got == _brute_mix([(i, s, t) for i, s, t in data], block_tokens, exponent)
    assert len({r[0] for r in got}) == len({i for i, _, _ in data})   # each document at least once
    assert "block" in mixed.columns and mixed.columns.count("mix_epoch") == 1


def test_mixing_budget_and_entropy(spark):
    docs, _ = _mix_docs(spark)
    for share in (0.5, 0.9, 1.0):
        mixed = mixing.mix(docs, min_entropy=share, budget=3000, block_tokens=100)
        per = {r.source: r.n for r in mixed.groupBy("source").agg({"text": "count"}).withColumnRenamed("count(text)", "n").collect()}
        total = mixed.select(mixing.word_count(mixed.text).alias("n")).groupBy().sum("n").first()[0]
        assert 3000 - len(per) <= total <= 3000 + 40 * len(per)
    assert mixing.mix(docs.limit(0), max_repeats=2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs)


# ---- 9: line dedup ----

def _brute_lines(data, window=3, min_words=20):
    """The operator's rule, spelled out: places in order of (id, line)."""
    blank = " \t\n\r\x0b\x0c"
    cut = re.compile(r"(?<=\n)|(?<=[.!?])(?=[ \t])")
    docs = []
    for i, t in sorted(data, key=lambda r: r[0]):
        lines = [x for x in _split(cut, t or "")]
        docs.append((i, lines, [x.strip(blank) for x in lines]))
    return docs


def _split(pattern, text):
    out, at = [], 0
    for m in pattern.finditer(text):
        if m.start() > 0:
            out.append(text[at:m.start()])
            at = m.start()
    return [*out, text[at:]]


def test_line_dedup_cuts_later_passages(spark):
    sentence = lambda k: " ".join(f"w{k}x{j}" for j in range(9)) + "."
    passage = [sentence(f"p{j}") for j in range(7)]
    own = lambda d, n=4: [sentence(f"d{d}o{j}") for j in range(n)]
    data = [(1, " ".join([*own(1), *passage, *own(1, 2)])), (2, " ".join([*own(2), *passage])),
            (3, " ".join(["It starts " + passage[0], *passage[1:], *own(3, 30)])), (4, " ".join(own(4))),
            (5, " ".join([*own(5), "See the terms.", *own(55)])), (6, " ".join([*own(6), "See the terms.", *own(66)])),
            (7, " ".join(passage)), (8, None), (9, ""), (10, "\n\n  \n"),
            (11, "\n".join(["same line of five words"] * 12)), (12, " ".join([*own(1), *passage, *own(1, 2)]))]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS lines", "3 AS doc")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df.repartition(3)).collect()}
    assert got[1].text == data[0][1] and got[1].n_deleted == 0
    assert got[2].text == " ".join(own(2)) and got[2].kept
    assert got[3].text.startswith("It starts " + passage[0]) and passage[2] not in got[3].text
    assert all(x in got[3].text for x in own(3, 30))
    for i in (4, 5, 6):
        assert got[i].n_deleted == 0 and got[i].text == dict(data)[i]
    assert not got[7].kept and not got[12].kept
    assert got[8].text is None and got[9].text == "" and got[10].text == "\n\n  \n"
    assert got[11].text.strip() == "same line of five words" or got[11].n_deleted == 11
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
    assert set(df.columns) | {"n_deleted", "kept"} == set(line_dedup.line_dedup(df).columns)


def test_line_dedup_keeps_one_copy_of_everything(spark):
    """Random texts: nothing is lost from the corpus, and no run of eight
    shared lines of five words stays twice."""
    rng = random.Random(4)
    line = lambda k: f"line number {k} goes on."
    shared = [[line(f"s{j}n{i}") for i in range(rng.randint(8, 14))] for j in range(6)]
    data = []
    for d in range(60):
        text = []
        for part in range(rng.randint(1, 5)):
            text += rng.choice(shared) if rng.random() < 0.4 else [line(f"d{d}p{part}i{i}") for i in range(rng.randint(1, 6))]
        data.append((d, "\n".join(text)))
    out = line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    before = {x for _, t in data for x in t.split("\n")}
    after = [x.strip() for r in out for x in re.split(r"\n|(?<=\.)(?= )", r.text) if x.strip()]
    assert before == set(after)
    for passage in shared:
        times = max(after.count(x) for x in passage[3:-3])
        assert times <= 1


def _brute_deleted(data, min_words=20):
    """Numbers of deleted lines by id: lines in a stretch of ``min_words`` words
    that stands at an earlier place too. Every stretch is compared."""
    blank, cut = " \t\n\r\x0b\x0c", re.compile(r"(?<=\n)|(?<=[.!?])(?=[ \t])")
    seen, out = set(), {}
    for i, text in sorted(data):
        full = [(k, x.strip(blank)) for k, x in enumerate(_split(cut, text)) if x.strip(blank)]
        out[i] = set()
        for a in range(len(full)):
            n = 0
            for b in range(a, len(full)):
                n += len(full[b][1].split(" "))
                if n >= min_words:
                    stretch = tuple(x for _, x in full[a:b + 1])
                    if stretch in seen:
                        out[i].update(range(full[a][0], full[b][0] + 1))
                    seen.add(stretch)
    return out


def _deleted(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}


def test_line_dedup_finds_passages_whose_lines_stand_alone_earlier(spark):
    """A passage's lines, and blank lines, each stand in earlier texts as well."""
    line = lambda k: f"Line {k} of the passage has words."
    passage = [line(k) for k in range(10)]
    own = lambda d: [f"Text {d} has its own line {j}." for j in range(20)]
    data = [(k, " ".join([*own(k)[:3], line(k), *own(k)[3:]])) for k in range(10)]
    data += [(20, "\n\n".join([*own(20), *passage])), (21, " ".join([*own(21), *passage])),
             (22, "\n".join([*own(22)[:9], "", *passage[:5], "", "", *passage[5:], "", *own(22)[9:]]))]
    got, want = _deleted(spark, data), _brute_deleted(data)
    assert {i: r.n_deleted for i, r in got.items()} == {i: len(x) for i, x in want.items()}
    assert got[20].text == dict(data)[20] and all(got[k].n_deleted == 0 for k in range(10))
    for i in (21, 22):
        assert not any(x in got[i].text for x in passage) and all(x in got[i].text for x in own(i))


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    stock = [" ".join(f"{c}{j}" for j in range(rng.choice([1, 1, 2, 4, 9, 25]))) + "." for c in "abcdefgh"] + ["", " "]
    data = [(d, "\n".join(rng.choices(stock, k=rng.randint(0, 25)))) for d in range(80)]
    got = {i: r.n_deleted for i, r in _deleted(spark, data).items()}
    assert got == {i: len(x) for i, x in _brute_deleted(data).items()} and 0 < sum(n > 0 for n in got.values()) < 80


@pytest.mark.parametrize("min_words", [1, 2, 9, 33])
def test_stretches_of_other_lengths_equal_brute_force(spark, min_words):
    rng = random.Random(min_words)
    stock = [" ".join(f"{c}{j}" for j in range(rng.choice([1, 1, 2, 5, 12, 40]))) + "." for c in "abcdefghijklmnop"]
    data = [(d, "\n".join(rng.choices(stock, k=rng.randint(0, 50)))) for d in range(50)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_deleted for r in line_dedup.line_dedup(df, min_words=min_words).collect()}
    assert got == {i: len(x) for i, x in _brute_deleted(data, min_words).items()} and any(got.values())


@pytest.mark.parametrize("n_lines", [1, 2, 3])
def test_line_dedup_finds_passages_of_few_lines(spark, n_lines):
    """Passages of sixty words in one to three lines, each in three texts with other neighbours."""
    size = 60 // n_lines
    passage = lambda k: [" ".join(f"p{k}w{j}" for j in range(a, a + size)) + "." for a in range(0, 60, size)]
    own = lambda d, j: f"Text {d} has its own line {j}."
    data = [(d, " ".join([own(d, 0), own(d, 1), own(d, 2), *passage(d % 10), own(d, 3), own(d, 4)])) for d in range(30)]
    got = _deleted(spark, data)
    assert [got[d].n_deleted for d in range(30)] == [0] * 10 + [n_lines] * 20
    assert all(x in got[d].text for d in range(10) for x in passage(d))
    assert all(own(d, j) in got[d].text for d in range(30) for j in range(5))


def test_line_dedup_cuts_runs_of_a_short_line(spark):
    """One short line repeated, alone or two in turn, within a text and across texts."""
    own = lambda d: [f"Text {d} has its own line {j}." for j in range(40)]
    data = [(1, "\n".join([*own(1), *["menu"] * 125, "end."])), (2, "\n".join([*own(2), *["menu"] * 60])),
            (3, "\n".join([*own(3), *["home", "next page"] * 30])), (4, "\n".join([*own(4), *["menu"] * 15]))]
    got, want = _deleted(spark, data), _brute_deleted(data)
    assert {i: r.n_deleted for i, r in got.items()} == {i: len(x) for i, x in want.items()}
    assert [got[i].text.split("\n").count("menu") for i in (1, 2, 4)] == [1, 0, 15]
    assert got[3].text.split("\n").count("home") == 1 and all(x in got[3].text for x in own(3))


def test_passages_with_tabs_or_without_spaces(spark):
    rng = random.Random(9)
    chinese = "".join("".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(9)) + "。" for _ in range(30))
    tabs = "\t".join(f"w{rng.randint(0, 10 ** 9)}" for _ in range(200))
    spaced = "   ".join(f"v{rng.randint(0, 10 ** 9)}" for _ in range(60))
    thin = "a" + " " * 300 + "b"      # two words, whatever is between them
    data = []
    for i, passage in enumerate((chinese, tabs, spaced, thin)):
        own = lambda: "".join(f"Own line {rng.random()} here. " for _ in range(6))
        data += [(2 * i, f"{own()}\n{passage}\n{own()}"), (2 * i + 1, f"{own()}\n{passage}\n{own()}")]
    got = _by_id(spark, data)
    texts = dict(data)
    for i, passage in enumerate((chinese, tabs, spaced)):
        assert got[2 * i].text == texts[2 * i] and got[2 * i].n_deleted == 0
        assert passage not in got[2 * i + 1].text and got[2 * i + 1].n_deleted == (30 if i == 0 else 1)
        assert got[2 * i + 1].text.count("Own line") == 12
    assert got[7].n_deleted == 0


def test_lines_join_to_their_text(spark):
    texts = ["a. b! c?\nd\n\n", "句。子！x. y", "。 \t. ", "", "\n", "a.\tb. c.d ?\n e"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", line_dedup.lines_of(F.col("text")).alias("l")).collect()
    assert all("".join(r.l) == r.text for r in rows)
    cut = {r.text: r.l for r in rows}
    assert cut["a. b! c?\nd\n\n"] == ["a.", " b!", " c?\n", "d\n", "\n", ""]
    assert cut["句。子！x. y"] == ["句。", "子！", "x.", " y"]


def _by_id(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}

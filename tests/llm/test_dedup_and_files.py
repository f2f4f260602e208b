"""Operators 1, 4 and 10: odd rows, round trips, brute force."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest

from orderscope.llm import exact_dedup, token_files, warc
from orderscope.llm.common import importable
from orderscope.llm.queries import tokenizer_path


@pytest.fixture(scope="module", autouse=True)
def _package_in_workers(spark):
    importable(spark)

ODD = [
    (1, "a  b", "x"), (2, "a b", None), (3, "a\t\n b", "x"), (4, None, "x"), (5, "", "y"), (6, " ", "y"),
    (7, "a b ", "z"), (None, "a b", "z"), (None, "lone", "z"), (9, "twice", "z"), (9, "twice", "z"),
    (8, "long " * 30_000, "z"), (10, "a b", "z"), (12, "long " * 30_000, None),
]


def _docs(spark, data=ODD):
    # Extra columns whose names clash with those used inside and returned.
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    return df.selectExpr("*", "1 AS slot", "'d' AS digest", "2 AS keep_id", "3 AS n", "4 AS bucket")


def _brute_dedup(data):
    norm = lambda t: re.sub("[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, _ in data:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t, _ in data:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [2, 3, 8])
def test_exact_dedup(spark, most):
    got = exact_dedup.exact_dedup(_docs(spark).repartition(5), most=most)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute_dedup(ODD)


def test_exact_dedup_of_nothing_and_of_one_text(spark):
    assert exact_dedup.exact_dedup(_docs(spark).limit(0)).count() == 0
    hot = spark.range(5000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same  text', concat('t', id)) AS text")
    got = exact_dedup.exact_dedup(hot)
    assert got.filter("group_size = 1667 AND keep_id = 0").count() == 1667
    assert got.filter("kept").count() == 3334


def test_exact_dedup_merges_as_a_stream_in_the_executor(spark):
    plan = exact_dedup.exact_dedup(_docs(spark))._jdf.queryExecution().executedPlan().toString()
    merges = exact_dedup._merge(spark.range(9).selectExpr(
        "int(id % 3) AS slot", "int(id) AS bucket", "unhex(hex(id)) AS digest", "id % 2 AS check", "id AS n_bytes",
        "id", "id AS n"), 4)
    inner = merges._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan + inner and "Python" not in plan + inner
    assert "SortAggregate" in inner and " HashAggregate" not in inner and inner.count("Exchange") == 1


def test_tree_shape():
    for partitions in (1, 2, 12, 51, 211, 1000):
        radix, rounds = exact_dedup.tree_shape(partitions, 8)
        assert partitions <= radix ** rounds and radix <= 8
        assert rounds == 1 or 8 ** (rounds - 1) < partitions


def _tokenizer():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


TEXTS = ["", None, " \n ", "Don't I'LL we'd", "a.b,c. d., e.,f x. y,", "<|endoftext|> </s>", "é🙂 漢字 \n\n x",
         "İstanbul ΟΔΟΣ     end", "é a ́b", "word " * 20_000, "ABC,abc.Abc. 12.5, 3,000."]


def test_token_files_round_trip(spark):
    data = [(i * 7 % 11, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "same id"), (3, "same id")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS start")
    manifest = token_files.write_tokens(docs.repartition(4), tokenizer_path("word_bpe_49k.json"), 2, length=64)
    got = sorted((tuple(r) for r in token_files.read_documents(manifest).collect()), key=lambda r: r[1])
    tokenizer, start, want = _tokenizer(), 0, []
    for i, t in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_sequences_are_views_of_equal_length(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(300)], "doc_id long, text string")
    manifest = token_files.write_tokens(docs.coalesce(1), tokenizer_path("word_bpe_49k.json"), 2, length=16)
    total = 0
    for row in manifest.collect():
        shard = token_files.open_shard(row.tokens_file.removeprefix("file://"))
        n = sum(shard.get_batch(i).num_rows for i in range(shard.num_record_batches))
        for k in range(n):
            ids, mask = token_files.sequence(shard, k)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            assert mask.all() or k == n - 1
            total += mask.sum()
    assert total == manifest.groupBy().sum("n_tokens").first()[0]


def test_token_files_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = token_files.write_tokens(docs, tokenizer_path("word_bpe_49k.json"), 2)
    assert manifest.count() == 0 and token_files.read_documents(manifest).count() == 0


PAGES = [(1, "http://a/\r\nX: y%41é", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""),
         (5, "u", "lone\r\n\r\nWARC/1.1"), (None, "n", "lone\r\n\r\nWARC/1.1"), (7, "big", "x" * 3_000_000),
         (8, "dup", "d"), (8, "dup", "d"), (6, "dup", "d")]


def _pages(spark, data=PAGES):
    return spark.createDataFrame(data, "page_id long, url string, html string").selectExpr(
        "*", "1 AS digest", "'x' AS payload", "2 AS refers_to", "3 AS response")


def _brute_warc(data, min_bytes=0):
    body = [(h or "").encode() for _, _, h in data]
    out = []
    for (i, url, _), b in zip(data, body, strict=True):
        winner = max((x[0] for x, y in zip(data, body, strict=True) if y == b and x[0] is not None), default=None)
        response = i == winner or len(b) < min_bytes
        out.append((i, url, "response" if response else "revisit", None if response else winner,
                    base64.b32encode(hashlib.sha1(b).digest()).decode(), len(b), b if response else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 2])
def test_warc_round_trip(spark, min_bytes):
    index = warc.write_warc(_pages(spark).repartition(3), min_bytes=min_bytes)
    got = warc.read_warc(index).collect()
    fields = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")
    clean = [tuple(bytes(r[f]) if f == "payload" and r[f] is not None else r[f] for f in fields) for r in got]
    assert sorted(clean, key=str) == _brute_warc(PAGES, min_bytes)


def test_warc_reads_a_selection(spark):
    index = warc.write_warc(_pages(spark))
    some = warc.read_warc(index.filter("page_id IN (1, 7)"))
    assert sorted(r.page_id for r in some.collect()) == [1, 7]
    assert warc.read_warc(warc.write_warc(_pages(spark).limit(0))).count() == 0


def test_ranges_join_neighbours_only():
    gap, most = warc.GAP_BYTES, warc.READ_BYTES
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + gap, 5), ("a", 26 + 2 * gap, 5), ("b", 0, most), ("b", most, 1)]
    got = [(f, s, n, len(g)) for f, s, n, g in warc._ranges(rows)]
    assert got == [("a", 0, 25 + gap, 3), ("a", 26 + 2 * gap, 5, 1), ("b", 0, most, 1), ("b", most, 1, 1)]


def test_token_files_equal_the_unmodified_library(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = ["end <|endoftext|> start", "end<|endoftext|>start.", "<|endoftext|>", "<|startoftext|><|endoftext|>\n",
             "<|ENDOFTEXT|> <|EndOfText|>", "<|endoftext", "A <|startoftext|> B <|ENDOFTEXT|>.", "plain text", None, "",
             "DİYARBAKIRİ. İ, gelİ.", "é<|endoftext|>́. क़.", "I'<|endoftext|>s 1<|endoftext|>2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    manifest = token_files.write_tokens(docs.coalesce(1), tokenizer_path("word_bpe_49k.json"), 2, length=8,
                                        special_in_text=True)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(manifest).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)


def test_words_with_special_tokens_stay_in_their_texts():
    path = tokenizer_path("word_bpe_49k.json")
    words, special = token_files.encoder(path)[0], token_files.special_pattern(path)
    texts = ["a <|endoftext|>", "b", "", "<|startoftext|>c<|ENDOFTEXT|>"]
    split = token_files.split_words(texts, special)
    assert [len([w for w in x if w]) for x in split.to_pylist()] == [2, 1, 0, 2]
    ids, lengths = words.texts(split)
    assert lengths.sum() == len(ids) and lengths[0] == 2 and ids[1] == 49407


def test_token_query_gives_special_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    from orderscope.llm.queries import op4_token_files
    text = "end <|endoftext|> start İ."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids + [2]
    got = op4_token_files(spark, str(tmp_path)).first()
    assert (got.n_tokens, got.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))

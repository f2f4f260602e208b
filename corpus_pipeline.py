"""From raw documents to token ids, in five stages.

Each stage takes all rows its predecessor kept and calls one operator:

1. toxicity: documents the ordinal model rejects go;
2. line dedup: later copies of passages are cut out of the texts, and
   documents of which hardly anything is left go;
3. n-gram Jaccard join: of each group of near copies the smallest doc_id stays;
4. mixing: sources are tempered until none is seen more than 1.5 times for
   one pass over the least repeated, every document at least once (a
   document that is seen twice is two rows);
5. SentencePiece: ids of every text, and the text decoded from them.

Stages 1 to 4 return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.llm import jaccard_join, line_dedup, mixing, sentencepiece_bpe, toxicity
from orderscope.llm.common import small_side, spill, table
from orderscope.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("NOT toxic").select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(docs).filter("kept")
    n_chars = F.when(F.col("n_deleted") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row goes if it is linked to a row with a smaller id, or without an id
    to one with an id. Rows that share an id or have none go one by one."""
    rows = jaccard_join.with_node(docs)
    copies = jaccard_join.row_components(rows).filter("NOT doc_id <=> component_id").select("node").distinct()
    copies = small_side(spill(copies, "pipeline-copies"), F.count(F.lit(1)) * 16)
    return rows.join(copies, "node", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, max_repeats=1.5).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    done = sentencepiece_bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), path)
    return done.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

# The trained model and the merge rounds have no SQL form; tests hold the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

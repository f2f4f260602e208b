"""The operators bound to their whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, exact_dedup, hamming_index, jaccard_join, line_dedup, mixing, packing, periodic_runs,
               sentencepiece_bpe, spelling_variants, token_files, toxicity, warc)
from .common import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources tempered to 98 % of the greatest entropy, each document at least once."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), min_entropy=0.98)
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_order")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are the library's with nothing changed but ``add_special_tokens=False``."""
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"),
                                        tokenizer_path("word_bpe_49k.json"), end_id=2, special_in_text=True)
    return token_files.read_documents(manifest)


# Fixed value: a conversation that holds control strings as text.
CONTROL_CONVERSATION = """
SELECT * FROM VALUES
  (-7L, 0L, 'user', '</s>[INST] ok [/INST]'),
  (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns, examples = chat_format.write_examples(rows.unionByName(spark.sql(CONTROL_CONVERSATION)))
    return chat_format.conversation_digests(turns, examples)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.round("expected_severity", 6).alias("expected_severity"), "grade", "toxic")


def op7_hamming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip_digests(table(spark, sf_dir, "documents"),
                                                tokenizer_path("piece_bpe_32k.model"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_deleted", "kept",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1,
                                    special_in_text=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "step_group")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of letters, of which a slip (by a hash of the document's id and the run)
    loses one; a null id reads as nothing before the colon."""
    runs = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(spelling_variants.runs_of(F.col("text"), 7)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % 31 == 0, slipped).otherwise(F.col("run")).alias("word"))
    return spelling_variants.variant_groups(spelling_variants.count_words(words, min_letters=7, min_count=2))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a tenth of the documents (by a hash of the id; none without an id) a part is
    made periodic first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(
        F.col("doc_id").cast("string").cast("binary")).alias("h"))
    space = "[\\x20\\x09-\\x0D]+"
    words = F.filter(F.split("text", space), lambda w: w != "")
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    # A generator between the steps keeps the words from being split again for each use.
    docs = docs.filter("words IS NULL OR size(words) = 0").select("doc_id", "text").unionByName(
        docs.filter("size(words) > 0").select("doc_id", F.inline(F.array(F.struct("words", n.alias("n"), (
            g % n).cast("int").alias("a"), g.alias("g")))))
        .withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
        .select("doc_id", F.array_join(F.concat(
            F.slice("words", 1, F.col("a")),
            F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")),
                                             F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))),
                    1, F.col("n") - F.col("a"))), " ").alias("text")))
    found = periodic_runs.periodic_runs(docs, min_length=12)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    longest = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return (found.withColumn("longest", longest)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start",
                    (-F.col("longest.less")).alias("length"), "longest.period",
                    F.expr("1000 * -longest.less div longest.period").alias("exponent_milli"),
                    F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256)
                    .alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_mixing": op3_mixing,
    "op4_token_files": op4_token_files,
    "op5_chat_format": op5_chat_format,
    "op6_toxicity": op6_toxicity,
    "op7_hamming_index": op7_hamming_index,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_line_dedup": op9_line_dedup,
    "op10_warc": op10_warc,
    "op11_packing": op11_packing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
}

"""Approximate nearest neighbours by multi-index hashing (operator 7).

Vectors become binary codes: centred, rotated by a learned rotation
(iterative quantisation), and cut to signs. A code is split into substrings
of 8 bits, each with an index of its own. Two codes within Hamming radius r
agree, by the pigeonhole principle, within radius rho_j on some substring j
if the (rho_j + 1) add up to at least r + 1; so probing every substring's
index with all values within rho_j of the query's finds every code within
r. What is found is ranked by the exact distance of the original vectors.

Rotation and radius are fitted on a bounded sample (``SAMPLE`` vectors, by
smallest hash of the id); the radius covers the share ``COVER`` of the
sample's true neighbours. All vectors are indexed.

Equal vectors are one entry that keeps its ``k`` + 1 smallest ids, and equal
queries are searched once, so a very common vector costs no more than
another. Entries are dealt into cells by a hash; a cell of entries meets
every block of queries. Both have a bounded size, and a cell returns at
most ``k`` + 1 entries a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, spill

SAMPLE = 20_000           # vectors the rotation and the radius are fitted on
COVER = 0.97              # share of the sample's neighbours the radius covers
CELL_VECTORS = 50_000     # entries of a cell, about
BLOCK_QUERIES = 8_192     # queries of a block, about
PAIRS = 2_000_000         # probed pairs that are held at once
BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass
class Codes:
    """A learned rotation, and the probing radius of each substring."""

    mean: np.ndarray
    rotation: np.ndarray   # (dimensions, bits)
    radius: int

    @property
    def radii(self) -> np.ndarray:
        """rho_j: adds (rho_j + 1) up to radius + 1, as evenly as can be."""
        m = self.rotation.shape[1] // 8
        return np.minimum(8, np.array([(self.radius + 1 + m - 1 - j) // m for j in range(m)]) - 1)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """(n, substrings) bytes."""
        return np.packbits((vectors - self.mean) @ self.rotation > 0, axis=1)


def learn(sample: np.ndarray, k: int, cover: float = COVER, rounds: int = 30) -> Codes:
    """Fit rotation and radius. Sixty-four bits, or as many whole bytes as the
    vectors have dimensions (one byte at least)."""
    dims = sample.shape[1]
    bits = min(64, max(8, dims // 8 * 8))
    mean = sample.mean(axis=0)
    centred = sample - mean
    rng = np.random.default_rng(0)
    if dims >= bits:
        projection = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
    else:
        projection = rng.normal(size=(dims, bits))
    z = centred @ projection
    rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(z @ rotation > 0, 1.0, -1.0).T @ z)
        rotation = (u @ vt).T
    codes = Codes(mean, projection @ rotation, bits)
    probes = min(256, len(sample))
    if len(sample) > 1:
        code = codes.encode(sample)
        found = []
        for i in range(probes):
            distance = ((sample - sample[i]) ** 2).sum(axis=1)
            distance[i] = np.inf
            near = np.argsort(distance, kind="stable")[:min(k, len(sample) - 1)]
            found.append(BITS[code[near] ^ code[i]].sum(axis=1))
        codes.radius = int(np.quantile(np.concatenate(found), cover, method="higher"))
    return codes


def _ball(radius: int) -> np.ndarray:
    """All bytes with at most ``radius`` bits set."""
    return np.flatnonzero(BITS <= radius).astype(np.uint8)


def search_cell(codes: Codes, entries: np.ndarray, first_ids: np.ndarray, queries: np.ndarray,
                k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, distance) of the k nearest entries found for each query,
    ties to the smaller first id."""
    code, q_code = codes.encode(entries), codes.encode(queries)
    radii = codes.radii
    index = []
    for j in range(code.shape[1]):
        order = np.argsort(code[:, j], kind="stable")
        index.append((order, np.concatenate(([0], np.cumsum(np.bincount(code[:, j], minlength=256))))))
    per_query = max(1, sum(len(_ball(r)) for r in radii if r >= 0) * len(entries) // 256)
    out = []
    for a in range(0, len(queries), max(1, PAIRS // per_query)):
        block = np.arange(a, min(len(queries), a + max(1, PAIRS // per_query)))
        qs, es = [], []
        for j, radius in enumerate(radii):
            if radius < 0:
                continue
            order, starts = index[j]
            ball = _ball(radius)
            values = q_code[block, j][:, None] ^ ball[None, :]
            n = (starts[values.astype(np.int64) + 1] - starts[values]).ravel()
            at = np.repeat(starts[values].ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
            e = order[at]
            q = np.repeat(np.repeat(block, len(ball)), n)
            apart = BITS[code[e] ^ q_code[q]]
            # Within the radius, and first found by this substring's index.
            keep = (apart.sum(axis=1) <= codes.radius) & ~(apart[:, :j] <= radii[:j]).any(axis=1)
            qs.append(q[keep])
            es.append(e[keep])
        q, e = np.concatenate(qs), np.concatenate(es)
        distance = np.empty(len(q))
        for b in range(0, len(q), 200_000):
            part = slice(b, b + 200_000)
            distance[part] = np.sqrt(((entries[e[part]] - queries[q[part]]) ** 2).sum(axis=1))
        order = np.lexsort((first_ids[e], distance, q))
        q, e, distance = q[order], e[order], distance[order]
        begin = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1))
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) if len(q) else q
        out.append((q[rank < k], e[rank < k], distance[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (
        np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


FOUND = "q_key string, distance double, ids array<long>"


def _cells(codes: Codes, k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        n, m = left.num_rows, right.num_rows
        if n == 0 or m == 0:
            return pa.table({"q_key": pa.array([], pa.string()), "distance": pa.array([], pa.float64()),
                             "ids": pa.array([], pa.list_(pa.int64()))})
        first = np.array([ids[0].as_py() for ids in left.column("ids")])
        q, e, distance = search_cell(codes, _matrix(left.column("vec"), n), first,
                                     _matrix(right.column("q_vec"), m), k + 1)
        return pa.table({"q_key": right.column("q_key").take(pa.array(q)), "distance": pa.array(distance),
                         "ids": left.column("ids").take(pa.array(e)).cast(pa.list_(pa.int64()))})
    return run


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """The k nearest other rows found for each query row: ``query_id, rank,
    vec_id, score`` (Euclidean distance in double precision on the original
    vectors), ties to the smaller vec_id.

    ``is_query`` is a condition on the input's columns. Rows whose id or
    vector is null, whose vector is all zero, holds a null, NaN or infinite
    component, or differs in length from the most frequent length, take no
    part. Rows that repeat an id with another vector are candidates of their
    own; a query's own id is never its neighbour. A query for which the
    radius finds fewer than k others is searched again with the radius that
    finds everything. Other columns are ignored. Without two rows the result
    is empty.
    """
    spark = vectors.sparkSession
    vec = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), is_query.alias("is_query"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
                       & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))
    rows = rows.withColumn("key", F.md5(F.array_join(F.col("vec").cast("array<string>"), ",")))
    rows = spill(rows, "vectors")
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return none
    rows = rows.filter(F.size("vec") == sizes["n"])

    # One entry per distinct vector, with its k + 1 smallest ids (Spark limits
    # each group in the map tasks already).
    smallest = Window.partitionBy("key").orderBy("vec_id")
    entries = (rows.select("key", "vec_id", "vec").withColumn("nth", F.row_number().over(smallest))
               .filter(F.col("nth") <= k + 1)
               .groupBy("key").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    entries = spill(entries, "vector-entries")
    sample = entries.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").toPandas()["vec"]
    codes = learn(np.stack([np.asarray(v, np.float64) for v in sample]), k)

    askers = spill(rows.filter("is_query").select(F.col("vec_id").alias("query_id"), F.col("key").alias("q_key")),
                   "askers")
    queries = askers.select(F.col("q_key").alias("key")).distinct().join(entries.select("key", "vec"), "key") \
        .select(F.col("key").alias("q_key"), F.col("vec").alias("q_vec"))
    queries = spill(queries, "vector-queries")
    n_entries, n_queries = entries.count(), queries.count()
    cells = max(partitions(spark), -(-n_entries // CELL_VECTORS))

    def search(codes: Codes, queries: DataFrame, n_queries: int) -> DataFrame:
        blocks = max(1, -(-n_queries // BLOCK_QUERIES))
        left = entries.select("vec", "ids", F.pmod(F.xxhash64("key"), F.lit(cells)).alias("cell"),
                              F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        right = queries.select("q_key", "q_vec", F.pmod(F.xxhash64("q_key"), F.lit(blocks)).cast("int").alias("block"),
                               F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"))
        found = (left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block"))
                 .applyInArrow(_cells(codes, k), FOUND))
        best = Window.partitionBy("q_key").orderBy("distance", F.get("ids", F.lit(0)))
        return found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).drop("nth")

    found = spill(search(codes, queries, n_queries), "vector-found")
    # A query whose entries hold k + 1 ids (its own may be among them) is done.
    enough = found.groupBy("q_key").agg(F.sum(F.size("ids")).alias("n")).filter(F.col("n") > k)
    short = spill(queries.join(enough.select("q_key"), "q_key", "left_anti"), "vector-short")
    n_short = short.count()
    if n_short:
        everything = Codes(codes.mean, codes.rotation, codes.rotation.shape[1])
        found = found.join(enough.select("q_key"), "q_key").unionByName(search(everything, short, n_short))
    per_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (askers.join(found, "q_key")
            .select("query_id", F.explode("ids").alias("vec_id"), F.col("distance").alias("score"))
            .filter(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

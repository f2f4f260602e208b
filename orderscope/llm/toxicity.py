"""Toxicity by cumulative-link ordinal regression (operator 6).

Severity grades 0 < 1 < ... < K are predicted from word counts by one weight
vector shared over ordered thresholds: P(grade >= k) = sigmoid(w.x - t_k),
t_1 <= ... <= t_K. A document's expected severity is the sum of these
probabilities, and it is rejected when P(grade >= 1) reaches a half.

Features are words (lower-cased runs of letters) and their beginnings of 3 to
8 letters, as they are and not as hash buckets, so no rare word shares a
weight with a strong one, and a stem counts in forms never seen in training.
A feature's value is log(1 + count). The fit uses a bounded sample of labelled documents
(``MAX_LABELLED``, smallest hashes of the id first); Spark counts the
sample's words and selects at most ``MAX_FEATURES`` features, so what the
driver holds is bounded too. An L1 penalty picks the words that matter and
a second fit on those alone takes the shrinkage back.

The given labels say toxic or not, without a degree. Grades are derived
from them: 0 for clean documents; toxic ones get 1, or 2 if they hold more
cues (features far likelier in toxic documents) than the median toxic one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spill
from .words import chunks

MAX_LABELLED = 10_000     # labelled documents that the fit may use
MAX_FEATURES = 1_000      # features that the fit may use
MIN_SUPPORT = 5           # different labelled texts a feature must occur in
STEMS = range(3, 9)       # lengths of word beginnings
CUE_RATIO = 20.0          # a cue is so many times likelier in toxic documents
CUE_SHARE = 0.02          # ... and occurs in at least this share of them


def words_in(texts: pa.Array) -> pa.ListArray:
    """Lower-cased runs of letters of each text (empty strings may occur)."""
    return pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts), r"\P{L}+", " "), " ")


def _doc_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text_hash) to one row per distinct word with its count."""
    for batch in batches:
        for i in range(batch.num_rows):
            counts = pc.value_counts(words_in(batch.column("text").slice(i, 1)).flatten())
            words, n = counts.field("values"), counts.field("counts")
            yield pa.record_batch([pa.repeat(batch.column("doc")[i], len(words)), words, n.cast(pa.int64())],
                                  names=["doc", "word", "n"])


@dataclass
class CumulativeLink:
    """A fitted model: the words with a weight, their weights, the thresholds."""

    words: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, a column each."""
        return _sigmoid(margin[:, None] - self.thresholds[None, :])

    def margins(self, texts: pa.Array) -> np.ndarray:
        """w.x of each text."""
        words = words_in(texts)
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        out = np.zeros(len(texts))
        if not self.words or not len(coded):
            return out
        position, hits, docs = coded.indices.to_numpy(), [], []
        for size in (None, *STEMS):
            forms, wanted = _form(coded.dictionary, size)
            known = pc.index_in(pc.binary_join_element_wise(wanted, forms, ""),
                                value_set=pa.array(self.words, pa.string()))
            feature = pc.fill_null(known, -1).to_numpy()[position]
            hit = np.flatnonzero(feature >= 0)
            hits.append(feature[hit])
            docs.append(np.searchsorted(ends, hit, side="right") - 1)
        pair = np.concatenate(docs) * np.int64(len(self.words)) + np.concatenate(hits)
        pair, n = np.unique(pair, return_counts=True)
        np.add.at(out, pair // len(self.words), self.weights[pair % len(self.words)] * np.log1p(n))
        return out


def _form(words: pa.Array, size: int | None) -> tuple[pa.Array, str]:
    """(feature text, its mark) of words: whole, or the first ``size`` letters
    of words longer than that (null for others)."""
    if size is None:
        return words, "="
    longer = pc.greater(pc.utf8_length(words), size)
    return pc.if_else(longer, pc.utf8_slice_codeunits(words, 0, size), None), "^"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _gradients(margin, grade, thresholds):
    """d(mean loss)/d(margin), d(mean loss)/d(thresholds) of the ordinal model."""
    k = len(thresholds)
    above = _sigmoid(margin[:, None] - thresholds[None, :])          # P(y >= j), j = 1..k
    upper = np.concatenate([np.ones((len(grade), 1)), above], axis=1)  # P(y >= 0..k)
    rows = np.arange(len(grade))
    lower_tail = np.where(grade < k, upper[rows, np.minimum(grade + 1, k)], 0.0)
    p = np.maximum(upper[rows, grade] - lower_tail, 1e-12)
    slope = above * (1 - above)
    d_margin = np.zeros(len(grade))
    d_threshold = np.zeros(k)
    for j in range(k):
        enters, leaves = grade == j + 1, grade == j
        share = np.where(enters, -slope[:, j] / p, 0) + np.where(leaves, slope[:, j] / p, 0)
        d_margin += share
        d_threshold[j] = -share.sum()
    return d_margin / len(grade), d_threshold / len(grade)


def _loss(margin: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> float:
    n = len(grade)
    tail = np.concatenate([np.ones((n, 1)), _sigmoid(margin[:, None] - thresholds[None, :]), np.zeros((n, 1))], axis=1)
    rows = np.arange(n)
    return -np.log(np.maximum(tail[rows, grade] - tail[rows, grade + 1], 1e-12)).mean()


def _start(grade: np.ndarray) -> np.ndarray:
    share = np.array([(grade >= j).mean() for j in range(1, int(grade.max()) + 1)])
    return np.log((1 - share) / share)


def _select(doc, feature, value, n_docs, n_features, grade, l1=3e-3, rounds=150, most=200) -> np.ndarray:
    """Features with a positive weight under an L1 penalty (accelerated
    proximal gradient descent on features of unit size), the ``most`` largest."""
    thresholds, weights = _start(grade), np.zeros(n_features)
    scale = np.sqrt(np.bincount(feature, value ** 2, n_features) / n_docs) + 1e-9
    value = value / scale[feature]
    # Power iteration bounds the curvature, and so the step.
    probe = np.ones(n_features)
    for _ in range(20):
        probe = np.bincount(feature, value * np.bincount(doc, value * probe[feature], n_docs)[doc], n_features)
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 1.0 / (0.5 * norm / n_docs + 1.0)
    ahead, ahead_t, momentum = weights, thresholds, 1.0
    for _ in range(rounds):
        margin = np.bincount(doc, value * ahead[feature], n_docs)
        d_margin, d_t = _gradients(margin, grade, ahead_t)
        new = ahead - step * np.bincount(feature, value * d_margin[doc], n_features)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_t = np.maximum.accumulate(ahead_t - step * d_t)
        after = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        pull = (momentum - 1) / after
        ahead, ahead_t = new + pull * (new - weights), np.maximum.accumulate(new_t + pull * (new_t - thresholds))
        weights, thresholds, momentum = new, new_t, after
    best = np.argsort(-weights, kind="stable")[:most]
    return np.sort(best[weights[best] > 0])


def _fit(x: np.ndarray, grade: np.ndarray, ridge: float = 1e-5, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Fisher scoring on a dense design."""
    n, f = x.shape
    weights, thresholds = np.zeros(f), _start(grade)
    k = len(thresholds)
    for _ in range(rounds):
        margin = x @ weights
        d_margin, d_t = _gradients(margin, grade, thresholds)
        gradient = np.concatenate([x.T @ d_margin + ridge * weights, d_t])
        above = _sigmoid(margin[:, None] - thresholds[None, :])
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        tail = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        p = np.maximum(tail[:, :-1] - tail[:, 1:], 1e-9)             # P(y = 0..k)
        change = slope[:, :-1] - slope[:, 1:]                         # of p with the margin
        by_t = np.zeros((n, k + 1, k))                                # of p with each threshold
        for j in range(k):
            by_t[:, j, j] = slope[:, j + 1]
            by_t[:, j + 1, j] = -slope[:, j + 1]
        info = np.zeros((f + k, f + k))
        info[:f, :f] = (x * (change ** 2 / p).sum(axis=1)[:, None]).T @ x / n + ridge * np.eye(f)
        info[:f, f:] = x.T @ ((change / p)[:, :, None] * by_t).sum(axis=1) / n
        info[f:, :f] = info[:f, f:].T
        info[f:, f:] = np.einsum("nkj,nki,nk->ji", by_t, by_t, 1 / p) / n + 1e-9 * np.eye(k)
        move = np.linalg.solve(info, gradient)
        now, step = _loss(margin, grade, thresholds) + 0.5 * ridge * weights @ weights, 1.0
        while step > 1e-4:  # the full step may go too far; halve it until the loss falls
            new, new_t = weights - step * move[:f], np.maximum.accumulate(thresholds - step * move[f:])
            if _loss(x @ new, grade, new_t) + 0.5 * ridge * new @ new < now:
                break
            step /= 2
        else:
            break
        weights, thresholds = new, new_t
        if np.abs(step * move).max() < 1e-6:
            break
    return weights, thresholds


def fit_model(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> CumulativeLink:
    """Fit on a bounded sample of the labelled documents.

    Labels with a null id or a null label, and labels without a document,
    are left out; documents with equal texts count once. Without a toxic and
    a clean example no word has a weight and nothing is rejected.
    """
    spark = docs.sparkSession
    sample = (labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("toxic").cast("int").alias("toxic"))
              .dropna().groupBy("doc").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc"), "doc").limit(max_labelled))
    sample = spill(sample, "label-sample")     # at most max_labelled rows
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
             .join(F.broadcast(sample), "doc"))
    first = Window.partitionBy(F.xxhash64("text")).orderBy("doc")
    texts = texts.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    texts = spill(texts, "labelled")
    words = texts.select("doc", "text").mapInArrow(_doc_words, "doc long, word string, n long").filter("word != ''")
    words = spill(words, "labelled-tokens")
    with_words = words.select("doc").distinct()
    forms = [F.concat(F.lit("="), "word"), *(F.when(F.char_length("word") > k, F.concat(
        F.lit("^"), F.substring("word", 1, k))) for k in STEMS)]
    counts = spill(words.select("doc", "n", F.explode(F.array(*forms)).alias("word")).dropna()
                   .groupBy("doc", "word").agg(F.sum("n").alias("n"))
                   .join(F.broadcast(sample), "doc"), "labelled-words")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sum(n for t, n in sizes.items() if t), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return CumulativeLink([], np.zeros(0), np.full(2, np.inf))
    in_toxic = (F.col("a") + 0.5) / (n_toxic + 1)
    in_clean = (F.col("b") + 0.5) / (n_clean + 1)
    seen = counts.groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("a"),
                                      F.count_if(F.col("toxic") == 0).alias("b"))
    odds = F.log(in_toxic / in_clean)
    # Log-likelihood ratio of the word's two-by-two table against independence.
    a, b, n = F.col("a"), F.col("b"), float(n_toxic + n_clean)
    cell = lambda seen, row, col: F.when(seen > 0, seen * F.log(seen * n / (row * col))).otherwise(0.0)
    with_word, without = a + b, F.lit(n) - a - b
    ratio = (cell(a, with_word, F.lit(n_toxic)) + cell(b, with_word, F.lit(n_clean))
             + cell(n_toxic - a, without, F.lit(n_toxic)) + cell(n_clean - b, without, F.lit(n_clean)))
    chosen = (seen.filter((F.col("a") + F.col("b") >= MIN_SUPPORT) & (odds > 0))
              .withColumn("strength", ratio)
              .withColumn("cue", (F.exp(odds) >= CUE_RATIO) & (F.col("a") >= CUE_SHARE * n_toxic))
              .orderBy(F.desc("strength"), "word").limit(MAX_FEATURES).select("word", "cue").collect())
    words = sorted(r["word"] for r in chosen)
    cues = {r["word"] for r in chosen if r["cue"]}
    index = {w: i for i, w in enumerate(words)}
    table = spark.createDataFrame([(w, i, w in cues) for w, i in index.items()], "word string, feature int, cue boolean")
    # Sparse rows of the sample as numbers: at most max_labelled documents by
    # MAX_FEATURES features.
    cells = counts.join(F.broadcast(table), "word").select("doc", "feature", "n", "cue").toPandas()
    rows = with_words.join(F.broadcast(sample), "doc").orderBy("doc").toPandas()
    doc = np.searchsorted(rows["doc"].to_numpy(), cells["doc"].to_numpy())
    feature = cells["feature"].to_numpy(np.int64)
    n = cells["n"].to_numpy(np.float64)
    toxic = rows["toxic"].to_numpy() > 0
    cues = np.bincount(doc, n * cells["cue"].to_numpy(bool), len(rows))
    grade = np.zeros(len(rows), np.int64)
    grade[toxic] = 1 + (cues[toxic] > np.median(cues[toxic]))
    if grade.max() == 0 or (grade > 0).all():
        return CumulativeLink([], np.zeros(0), np.full(2, np.inf))
    value = np.log1p(n)
    active = _select(doc, feature, value, len(rows), len(words), grade)
    place = np.full(len(words), -1)
    place[active] = np.arange(len(active))
    keep = np.flatnonzero(place[feature] >= 0)
    x = np.zeros((len(rows), len(active)))
    x[doc[keep], place[feature[keep]]] = value[keep]
    weights, thresholds = _fit(x, grade)
    return CumulativeLink([words[i] for i in active], weights, thresholds)


def score(docs: DataFrame, model: CumulativeLink, text_col: str = "text") -> DataFrame:
    """``docs`` with ``expected_severity, grade, toxic``.

    ``grade`` is the likeliest grade, ``toxic`` says P(grade >= 1) >= 0.5.
    A null or empty text has no words and gets the base rates. Other columns
    stay; input columns of the three names are replaced."""
    added = {"expected_severity": "double", "grade": "int", "toxic": "boolean"}
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema),
                       *(f"{c} {t}" for c, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(text_col).cast(pa.string()), "")
            for a, b in chunks(texts.to_pylist()):
                above = model.at_least(model.margins(texts.slice(a, b - a)))
                full = np.concatenate([np.ones((b - a, 1)), above, np.zeros((b - a, 1))], axis=1)
                grade = np.argmax(full[:, :-1] - full[:, 1:], axis=1).astype(np.int32)
                yield pa.record_batch([*batch.slice(a, b - a).columns, pa.array(above.sum(axis=1)),
                                       pa.array(grade), pa.array(above[:, 0] >= 0.5)], names=[*names, *added])
    return rows.mapInArrow(run, types)

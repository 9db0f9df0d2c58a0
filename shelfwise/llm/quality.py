"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of documents labelled good (target) and one of all documents (raw),
give each document the weight p_target / p_raw. Adding Gumbel noise to the log weights and keeping the k largest
samples k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm import textnp
from shelfwise.llm.storage import stored
from shelfwise.sources.session import bounded_batches

#: Buckets of the hashed n-gram models.
BUCKETS = 1 << 14
#: Labelled documents that the target model and the cut are fitted on, about.
LABELLED = 20_000
#: Added to every bucket's count.
SMOOTHING = 1.0
#: Seed of the Gumbel noise.
SEED = 17

_KIND = np.full(256, 2, dtype=np.uint8)  # 0 white space, 1 word, 2 other signs
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_SHAPE = np.full(256, 16, dtype=np.uint8)  # upper, lower, digit, beyond ASCII, sign
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 4, 8


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per group of rows the buckets of all n-grams, and where each row's begin.

    Tokens are runs of word characters or of other signs. The n-grams are one and two tokens in lower case, and one to
    three token shapes: the kinds of characters in a token and whether it repeats the token before."""
    raw, offsets = textnp.column_bytes(column)
    for first, last in textnp.chunks(offsets):
        part = offsets[first : last + 1]
        data, part = raw[part[0] : part[-1]], part - part[0]
        kind = _KIND[data]
        edge = np.ones(len(data), dtype=bool)
        edge[1:] = kind[1:] != kind[:-1]
        edge[part[:-1][part[:-1] < len(data)]] = True
        begins = np.flatnonzero(edge & (kind > 0))
        runs = np.append(np.flatnonzero(edge), len(data))
        ends = runs[np.searchsorted(runs, begins, side="right")]
        starts = np.searchsorted(begins, part)
        if not len(begins):
            yield np.zeros(0, dtype=np.int64), starts * 0
            continue
        token = textnp.run_hashes(data, begins, ends)
        # a token's run ends where the next begins, or at white space whose shape is masked out
        shape = np.bitwise_or.reduceat(np.where(kind > 0, _SHAPE[data], 0).astype(np.uint8), begins).astype(np.uint64)
        row = np.repeat(np.arange(len(part) - 1), np.diff(starts))
        again = np.zeros(len(token), dtype=bool)
        again[1:] = (token[1:] == token[:-1]) & (row[1:] == row[:-1])
        shape = textnp.mix(shape * np.uint64(2) + again + np.uint64(977))
        grams, rows = [], []
        for values, size, salt in ((token, 1, 1), (token, 2, 2), (shape, 1, 3), (shape, 2, 4), (shape, 3, 5)):
            gram = textnp.ngrams(values + np.uint64(salt), size)
            inside = row[: len(gram)] == row[size - 1 :]
            grams.append((gram[inside] % np.uint64(BUCKETS)).astype(np.int64))
            rows.append(row[: len(gram)][inside])
        order = np.argsort(np.concatenate(rows), kind="stable")
        rows = np.concatenate(rows)[order]
        yield np.concatenate(grams)[order], np.searchsorted(rows, np.arange(len(part)))


@dataclass
class Model:
    """The log ratio of the two models per bucket, the number of documents to keep and the last score kept."""

    ratio: np.ndarray
    keep: int
    cutoff: float


def _labels(labels: DataFrame) -> DataFrame:
    """(label_id, good) of a bounded, hash-drawn part of the labelled documents; contradicting labels are left out."""
    clean = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.min("quality").alias("good"), F.max("quality").alias("most"))
        .where("good = most")
        .select("label_id", F.col("good").cast("int").alias("good"))
    )
    share = min(1.0, LABELLED / max(1, clean.count()))
    return clean.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))


def _noise() -> Column:
    """Standard Gumbel noise from the hashed id."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(SEED)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def _weights(column: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """Log importance weights of the rows, to six places; a row's doesn't depend on the rows beside it."""
    out = [np.zeros(0)]
    for buckets, starts in features(column):
        total, full = np.zeros(len(starts) - 1), starts[1:] > starts[:-1]
        if full.any():
            total[full] = np.add.reduceat(ratio[buckets], starts[:-1][full])
        out.append(np.round(total, 6))
    return np.concatenate(out)


def _ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Log of target over raw probability per bucket; None without both good and bad labels."""
    found = {r.good for r in labels.select("good").distinct().collect()}
    if found != {0, 1}:
        return None

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for column, count in ((batch.column(0), raw), (batch.column(0).filter(pa.compute.equal(batch.column(1), 1)), target)):
                for buckets, _ in features(column):
                    count += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    joined = docs.select("doc_id", "text").join(F.broadcast(labels), F.col("doc_id") == F.col("label_id"), "left").select("text", "good")
    counts = (
        joined.mapInArrow(tally, "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    )
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for row in counts:
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    # smoothing in proportion: a bucket the smaller target sample lacks is not held against a document
    scale = raw.sum() / target.sum()
    target = target + raw / scale * 0.1
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight that parts good from bad labels best (least sum of the two error rates), in the middle of the gap."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / max(1, g.sum())
    passed = 1 - np.concatenate([[0], np.cumsum(1 - g)]) / max(1, (1 - g).sum())
    real = np.concatenate([[True], w[1:] > w[:-1], [True]])
    error = np.where(real, lost + passed, 9.0)
    at = int(np.argmin(error))
    if at == 0:
        return float(w[0])
    return float((w[at - 1] + w[min(at, len(w) - 1)]) / 2)


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column without nulls, by counting in ever narrower ranges."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    part, bins = df, 4096
    while low < high:
        width = (high - low) / bins
        counts = (
            part.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin"))
            .agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        )
        for row in counts:
            if row.n >= k:
                break
            k -= row.n
        if (row.low, row.high) == (low, high):
            values = part.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc(column)).limit(bins).collect()
            for value, n in values:
                if n >= k:
                    return value
                k -= n
        low, high = row.low, row.high
        part = df.where(F.col(column).between(low, high))
    return low


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, DataFrame | None]:
    """The fitted selection, and the scores (doc_id, log_weight, score) of all documents, stored."""
    bounded_batches(docs.sparkSession)
    labels = stored(_labels(labels))
    ratio = _ratio(docs, labels)
    if ratio is None:
        return None, None
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = _weights(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(weight), pa.array(weight + batch.column(2).to_numpy())], names=["doc_id", "log_weight", "score"]
            )

    scores = stored(docs.select("doc_id", "text", _noise().alias("noise")).mapInArrow(score, "doc_id long, log_weight double, score double"))
    # one weight for each labelled id, at most ``LABELLED`` of them: of several texts of an id the least
    labelled = scores.join(F.broadcast(labels), F.col("doc_id") == F.col("label_id")).groupBy("label_id", "good").agg(F.min("log_weight").alias("log_weight"))
    known = labelled.toPandas()
    if known["good"].nunique() < 2:
        return None, None
    cut = _best_cut(known["log_weight"].to_numpy(), known["good"].to_numpy())
    keep = scores.where(F.col("log_weight") >= cut).count()
    cutoff = kth_largest(scores, "score", keep) if keep else float("inf")
    return Model(ratio, keep, cutoff), scores


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents kept: doc_id, log_weight, score.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality (1 good, 0 bad); other columns are ignored.
    k is the number of documents whose weight lies above the cut that parts the labelled ones best. A null or empty text
    has weight 0; documents tied with the k-th score are all kept; repeated rows are judged alike. With no label of one
    kind there is nothing to learn: all documents are kept, with weight and score 0.
    """
    model, scores = fit(docs, labels)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("score"))
    return scores.where(F.col("score") >= model.cutoff)


def resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`sampled` keeps, with all their columns."""
    model, _ = fit(docs, labels)
    if model is None:
        return docs
    shared, cutoff = docs.sparkSession.sparkContext.broadcast(model.ratio), model.cutoff
    place, last = docs.columns.index("text"), len(docs.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _weights(batch.column(place), shared.value) + batch.column(last).to_numpy()
            yield batch.select(list(range(last))).filter(pa.array(score >= cutoff))

    name = "noise"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.select("*", _noise().alias(name)).mapInArrow(keep, T.StructType(docs.schema.fields))

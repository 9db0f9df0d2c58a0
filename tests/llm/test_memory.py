"""Memory that tasks hold beside the rows they give."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfwise.llm import jaccard, quality
from shelfwise.sources import session


def _peak(work):
    """What ``work`` returns, and the MB it held at most."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _texts(n, words):
    rng = np.random.default_rng(5)
    return [" ".join(f"w{x}" for x in rng.integers(0, 5000, words)) for _ in range(n)]


def test_batches_of_wide_rows_are_cut_by_their_bytes(spark):
    own = spark.newSession()
    own.conf.set(session.BATCH, "64m")
    docs = own.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 200).alias("text"))
    labels = own.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for step in (lambda: jaccard.jaccard_components(docs.limit(5)), lambda: quality.sampled(docs.limit(5), labels)):
        own.conf.set(session.BATCH, "64m")
        step()
        assert session.size_bytes(own.conf.get(session.BATCH)) <= session.BATCH_BYTES

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["b", "n"])

    found = docs.mapInArrow(size, "b long, n long").collect()
    assert sum(r.n for r in found) == 6000 and max(r.b for r in found) < 1.1 * session.BATCH_BYTES
    own.conf.set(session.BATCH, "1m")
    session.bounded_batches(own)
    assert session.size_bytes(own.conf.get(session.BATCH)) == 1 << 20


def test_weights_hold_little_and_rest_on_the_row_alone():
    column = pa.array([*_texts(400, 1500), None, "", " "])
    ratio = np.random.default_rng(3).normal(size=quality.BUCKETS)
    together, held = _peak(lambda: quality._weights(column, ratio))
    assert held < 60
    alone = np.concatenate([quality._weights(column.slice(i, 1), ratio) for i in range(len(column))])
    assert (together == alone).all() and (together[-3:] == 0).all() and together[:400].all()


def test_trees_add_up_few_pairs_at_once():
    points = np.random.default_rng(7).integers(0, 3, (1024, jaccard.GROUPS)).astype(np.uint16)
    sizes, labels = points.sum(axis=1, dtype=np.int64), np.arange(1024)
    (q, e, _), held = _peak(lambda: jaccard.Tree(points, sizes, labels).search(points, sizes, labels))
    assert held < 30
    shared = np.array([np.minimum(p, points).sum(axis=1) for p in points[:64]])
    fits = 7 * shared >= 3 * (sizes[:64, None] + sizes[None, :])
    fits[np.arange(64), np.arange(64)] = False
    got = np.zeros((64, 1024), dtype=bool)
    got[q[q < 64], e[q < 64]] = True
    assert (got >= fits).all()


def test_frequent_shingles_are_counted_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "one two three four five" if i % 2 else f"a{i} b c d e") for i in range(400)], "doc_id long, text string")
    whole = jaccard._frequent(docs.coalesce(1))
    monkeypatch.setattr(jaccard, "TALLIED", 50)
    assert len(whole) == 1 and jaccard._frequent(docs.coalesce(1)).tolist() == whole.tolist()

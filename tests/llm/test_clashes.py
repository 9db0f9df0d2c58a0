"""Columns of the user's that bear names used inside, huge repetition rates, short benchmark items, many items at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import decontaminate, mixing, quality, sharding, storage

INSIDE = {
    "sharding": ["_slot", "_table_slot", "_table_shard", "row", "value"],
    "mixing": ["_mix_source", "_mix_unit", "_mix_first", "_mix_cdf", "_mix_times", "row", "id", "of", "first", "cdf", "unit", "times", "begin", "rate"],
    "quality": ["good", "label_id", "noise", "_gumbel_noise", "log_weight", "score", "bucket", "raw"],
}


def docs_of(spark, names):
    rows = [(i, f"some words of text {i} and {i % 7} more of them " * 3, "ab"[i % 2], "en", *[f"{n}{i}" for n in names]) for i in range(40)]
    return spark.createDataFrame(rows, ["doc_id", "text", "source", "lang", *names])


def test_sharding_keeps_clashing_columns(spark):
    names = INSIDE["sharding"]
    got = sharding.placed(docs_of(spark, names)).orderBy("doc_id").collect()
    plain = sharding.placed(docs_of(spark, [])).orderBy("doc_id").collect()
    assert [(r.slot, r.shard) for r in got] == [(r.slot, r.shard) for r in plain]
    assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert sharding.placed(docs_of(spark, []).withColumn("Slot", F.lit("x"))).columns == ["doc_id", "text", "source", "lang", "slot", "shard"]


def test_mixing_keeps_clashing_columns(spark):
    names = INSIDE["mixing"]
    got = mixing.mixed(docs_of(spark, names)).collect()
    plain = mixing.mixed(docs_of(spark, [])).collect()
    assert sorted((r.doc_id, r["copy"], r.shuffle_key) for r in got) == sorted((r.doc_id, r["copy"], r.shuffle_key) for r in plain)
    assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert mixing.mixed(docs_of(spark, []).withColumn("Copy", F.lit("x"))).columns == ["doc_id", "text", "source", "lang", "copy", "shuffle_key"]


def test_a_tiny_source_is_repeated_in_ranges(spark):
    docs = spark.createDataFrame([(1, "x", "tiny")] + [(k, "y" * 20000, "large") for k in range(2, 6)], "doc_id long, text string, source string")
    rows = mixing.mixed(docs).where("source = 'tiny'")
    copies = sorted(r["copy"] for r in rows.select("copy").collect())
    assert copies == list(range(1, len(copies) + 1)) and abs(len(copies) - 40000) < 1500


def test_quality_ignores_clashing_columns(spark):
    names = INSIDE["quality"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    got = quality.resampled(docs_of(spark, names), labels).collect()
    plain = quality.resampled(docs_of(spark, []), labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in plain)
    assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    odd = quality.sampled(docs_of(spark, names), labels.withColumn("good", F.lit("x")).withColumn("label_id", F.lit("y")))
    assert sorted(r.doc_id for r in odd.collect()) == sorted(r.doc_id for r in plain)


@pytest.mark.parametrize("text, item, place", [("his eyes are open", "yes", -1), ("oh yes", "yes", 3), ("eyes, yes!", "yes", 6), ("a+b", "+", 1), ("abc", "a", -1)])
def test_short_items_are_whole_words(text, item, place):
    assert decontaminate.whole_words(text, item) == place


def test_items_aligned_together_equal_items_aligned_alone():
    pick = np.random.default_rng(5)
    text = pick.integers(97, 101, 400).astype(np.uint64)
    items = [text[a : a + n].copy() for a, n in ((0, 30), (50, 90), (200, 33), (370, 30), (399, 1))]
    for item in items:
        item[pick.integers(0, len(item), max(1, len(item) // 15))] = 120
    lows = np.array([0, 45, 190, 365, 390])
    edits, starts, ends = decontaminate.aligned_many(items, text, lows, 20)
    for k, item in enumerate(items):
        m = len(item)  # the plain table over the same diagonals
        far = 10**6
        table = {(0, j): (0, j) for j in range(len(text) + 1) if lows[k] <= j < lows[k] + 20}
        for i in range(1, m + 1):
            for j in range(len(text) + 1):
                if lows[k] <= j - i < lows[k] + 20:
                    best = [(c + (text[j - 1] != item[i - 1]), s) for c, s in [table.get((i - 1, j - 1), (far, 0))] if j]
                    best += [(c + 1, s) for c, s in [table.get((i - 1, j), (far, 0)), table.get((i, j - 1), (far, 0))]]
                    table[i, j] = min(best)
        found = min((table[m, j], j) for j in range(len(text) + 1) if (m, j) in table)
        assert (edits[k], starts[k], ends[k]) == (*found[0], found[1])


def test_stored_tables_are_released(spark):
    before = storage.tables(spark)
    one, two = (storage.stored(spark.range(3)) for _ in range(2))
    storage.release(spark, since=before, keep=1)
    assert storage.tables(spark) == before + 1 and two.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        one.count()
    storage.release(spark, since=before)
    assert storage.tables(spark) == before

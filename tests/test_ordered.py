"""The distributed orderings give what a single ordering gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.functions.ordered import bounded_quantiles, percent_ranks, positions, quantiles, quantiles_of, running
from shelfwise.operators.aggregate import group_stats


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 3000
    # one key and one value hold more than a third of all rows
    return pd.DataFrame(
        {
            "id": np.arange(n),
            "k": np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n)),
            "v": np.where(rng.random(n) < 0.4, 5.0, rng.normal(0, 10, n).round(2)),
        }
    )


def test_running_total(spark, frame):
    df = spark.createDataFrame(frame).repartition(7)
    out = running(df, {"sofar": F.col("v")}, [F.desc("v"), F.col("id")], ["k"]).toPandas()
    want = frame.sort_values(["v", "id"], ascending=[False, True])
    want["sofar"] = want.groupby("k").v.cumsum()
    merged = out.merge(want[["id", "sofar"]], on="id")
    assert np.allclose(merged.sofar_x, merged.sofar_y)
    assert len(out) == len(frame)


@pytest.mark.parametrize("kind", ["long", "double", "decimal(9,2)"])
@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_running_total_of_any_type(spark, frame, kind, size):
    """Across slices and batches, with nulls and keys of one to half of all rows."""
    part = frame.assign(k=np.where(frame.id % 3 == 0, frame.k, frame.id.astype(str)), u=frame.v.where(frame.id % 5 > 0)).head(300 if size == 1 else 3000)
    part.loc[part.id % 11 == 0, "k"] = None
    df = spark.createDataFrame([(int(r.id), r.k, None if pd.isna(r.u) else float(r.u)) for r in part.itertuples()], "id long, k string, u double")
    df = df.withColumn("u", F.col("u").cast(kind)).repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        got = running(df, {"sofar": F.col("u"), "place": F.lit(1)}, [F.desc("id")], ["k"], {"sofar": "total"}).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sofar, place = {}, {}
    rows = sorted(df.collect(), key=lambda r: -r.id)
    want = {}
    for r in rows:
        place[r.k] = place.get(r.k, 0) + 1
        if r.u is not None:
            sofar[r.k] = sofar.get(r.k, 0) + r.u
        want[r.id] = (sofar.get(r.k), place[r.k], r.k)
    assert len(got) == len(want)
    for r in got:
        s, p, k = want[r.id]
        assert (r.place, r.k) == (p, k)
        assert r.sofar is None if s is None else float(r.sofar) == pytest.approx(float(s), abs=1e-7)
        assert r.total is None if sofar.get(k) is None else float(r.total) == pytest.approx(float(sofar[k]), abs=1e-7)


def test_running_total_needs_one_exchange_and_no_rows(spark, frame):
    df = spark.createDataFrame(frame)
    assert running(df.where("id < 0"), {"n": F.lit(1)}, [F.col("id")], ["k"]).count() == 0
    plan = positions(df, [F.col("v"), F.col("id")], ["k"])._jdf.queryExecution().executedPlan().toString()
    rows = plan.split("BroadcastExchange")[0]  # what is written is read and numbered without another exchange or sort
    assert "Exchange hashpartitioning" not in rows and "Window" not in rows


def test_positions_are_a_permutation(spark, frame):
    df = spark.createDataFrame(frame).repartition(5)
    out = positions(df, [F.col("v"), F.col("id")]).toPandas().sort_values("position")
    want = frame.sort_values(["v", "id"]).id.tolist()
    assert out.position.tolist() == list(range(1, len(frame) + 1))
    assert out.id.tolist() == want


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles(spark, frame, keys):
    df = spark.createDataFrame(frame).repartition(6)
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    out = quantiles(df, "v", probs, keys).toPandas()
    for _, row in out.iterrows():
        part = frame[frame.k == row.k] if keys else frame
        for name, p in probs.items():
            assert row[name] == pytest.approx(part.v.quantile(p))


def test_percent_ranks(spark, frame):
    df = spark.createDataFrame(frame).repartition(6)
    out = percent_ranks(df, "v", "r").toPandas().set_index("id").r.sort_index()
    assert np.allclose(out, frame.set_index("id").v.rank(pct=True).sort_index())


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_bounded_quantiles_agree(spark, frame, keys):
    df = spark.createDataFrame(frame)
    marks = {"a": 0.33, "b": 0.9}
    one, other = (found.orderBy(*keys).toPandas() if keys else found.toPandas() for found in (quantiles(df, "v", marks, keys), bounded_quantiles(df, "v", marks, keys)))
    assert np.allclose(one[["a", "b"]], other[["a", "b"]])


def test_null_keys_are_a_group(spark):
    rows = [(1, None, 2.0), (2, None, 3.0), (3, "x", 4.0), (4, "x", None), (5, None, None)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    assert {r.id: r.position for r in positions(df, [F.col("id")], ["k"]).collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 3}
    assert {r.k: r.m for r in quantiles(df, "v", {"m": 0.5}, ["k"]).collect()} == {None: 2.5, "x": 4.0}
    assert {r.id: r.r for r in percent_ranks(df, "v", "r", ["k"]).collect()} == {1: 0.5, 2: 1.0, 3: 1.0, 4: None, 5: None}
    assert {r.k: (r.rows, r.median) for r in group_stats(df, ["k"], "v").collect()} == {None: (3, 2.5), "x": (2, 4.0)}


def test_several_columns_in_one_ordering(spark, frame):
    df = spark.createDataFrame(frame)
    got = quantiles_of(df, {"v": {"v50": 0.5}, "id": {"i25": 0.25, "i75": 0.75}}, ["k"]).toPandas().set_index("k")
    for k, row in got.iterrows():
        part = frame[frame.k == k]
        assert (row.v50, row.i25, row.i75) == pytest.approx((part.v.quantile(0.5), part.id.quantile(0.25), part.id.quantile(0.75)))

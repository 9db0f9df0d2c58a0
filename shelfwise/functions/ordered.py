"""Running totals, positions and quantiles over orderings of any size.

A window without a bounded partition sends a whole ordering to one task. For running totals the rows are range-partitioned
on the full ordering, scanned slice by slice and materialised, and what earlier slices end with is added to the running
value inside a slice. Quantiles need no ordering: their ranks are found in histograms of narrowing bins. Null keys are a
group of their own. Frames that the calendar bounds use :func:`bounded_quantiles` or a plain window instead.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.sources.session import checkpointed

START = Window.unboundedPreceding


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, a null being equal to a null; the keys come from ``left``."""
    if not keys:
        return left.join(right, how=how)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; nulls are equal, and so are NaNs."""
    one, other = column[:-1], column[1:]
    same = pc.or_(pc.fill_null(pc.equal(one, other), False), pc.and_(pc.is_null(one), pc.is_null(other)))
    if pa.types.is_floating(column.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(one), pc.is_nan(other)), False))
    return ~same.to_numpy(zero_copy_only=False)


def _run(column: pa.Array, starts: np.ndarray, before: tuple) -> tuple[pa.Array, tuple]:
    """Totals up to each value since the last of ``starts``, null while no value was known, and the last of them.

    ``before`` holds the total and the number of known values that the first rows go on from."""
    known = np.cumsum(column.is_valid().to_numpy(zero_copy_only=False).astype(np.int64))
    values = pc.fill_null(column, pa.scalar(0, type=column.type)).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(starts)
    owner = np.searchsorted(cuts, np.arange(len(values)), side="right")  # 0: goes on from the batch before
    known = known + np.concatenate([[before[1]], -(known[cuts] - column.take(pa.array(cuts)).is_valid().to_numpy(zero_copy_only=False))])[owner]
    if values.dtype.kind == "i":
        whole = np.cumsum(values)
        total = whole + np.concatenate([[before[0]], -(whole[cuts] - values[cuts])])[owner]
    else:  # a difference of two sums would lose digits
        parts = np.split(values, cuts)
        total = np.concatenate([before[0] + np.add.accumulate(parts[0]), *map(np.add.accumulate, parts[1:])])
    return pa.array(total, type=column.type, mask=known == 0), (total[-1], known[-1])


def running(
    df: DataFrame,
    sums: Mapping[str, Column],
    order: Sequence[Column],
    keys: Sequence[str] = (),
    whole: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``sums`` accumulated up to each row of ``order`` within ``keys``; nulls add nothing.

    ``order`` must be a total order inside a key. ``whole`` names further columns for the totals of a key's sums. Rows are
    exchanged once, by ranges of keys and order, and scanned and written in that order. Only the first key of a slice can
    go on from earlier slices, so one row per slice, its last, holds all that the next one needs to know.
    """
    added = df.select(*[F.sum(value).alias(name) for name, value in sums.items()]).schema
    inputs = {f"_in_{f.name}": sums[f.name].cast(f.dataType) for f in added}
    names, keys = list(sums), list(keys)
    ranges = [*[F.col(k) for k in keys], *order]
    slices = df.withColumns(inputs).repartitionByRange(*ranges).sortWithinPartitions(*ranges).withColumn("_slice", F.spark_partition_id())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal.getcontext().prec = 76
        held, state = None, {n: (0, 0) for n in names}
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                column = batch.column(batch.schema.get_field_index(k))
                if held is not None:
                    column = pa.concat_arrays([held.column(held.schema.get_field_index(k))[-1:], column])
                starts[-len(column) + 1 :] |= _changes(column) if len(column) > 1 else False
            if held is not None:
                yield held
            done = []
            for n in names:
                column, state[n] = _run(batch.column(batch.schema.get_field_index(f"_in_{n}")), starts, state[n])
                done.append(column)
            held = pa.RecordBatch.from_arrays(
                [*batch.columns, *done, pa.array(np.zeros(batch.num_rows, dtype=bool))], names=[*batch.schema.names, *[f"_run_{n}" for n in names], "_end"]
            )
        if held is not None:
            last = np.arange(held.num_rows) == held.num_rows - 1
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(last)], names=held.schema.names)

    schema = T.StructType([*slices.schema, *[T.StructField(f"_run_{f.name}", f.dataType) for f in added], T.StructField("_end", T.BooleanType())])
    scanned = checkpointed(slices.mapInArrow(scan, schema))
    upto = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(START, 0)
    ends = scanned.where("_end").select(
        *keys, F.lead("_slice").over(Window.orderBy("_slice")).alias("_slice"), *[F.sum(f"_run_{n}").over(upto).alias(f"_off_{n}") for n in sums]
    )
    done = null_safe_join(scanned, F.broadcast(ends.where("_slice IS NOT NULL")), [*keys, "_slice"], "left")
    if whole:
        every = scanned.groupBy(*keys).agg(*[F.sum(f"_in_{n}").alias(name) for n, name in whole.items()])
        if keys:
            done = null_safe_join(done, every, keys)
        else:
            done = done.withColumn("_whole", every.select(F.struct("*")).scalar()).select("*", "_whole.*").drop("_whole")
    zero = {f.name: F.lit(0).cast(f.dataType) for f in added}
    total = lambda n: F.coalesce(f"_off_{n}", zero[n]) + F.coalesce(f"_run_{n}", zero[n])
    known = lambda n: F.coalesce(f"_off_{n}", f"_run_{n}").isNotNull()
    return done.withColumns({n: F.when(known(n), total(n)) for n in sums}).drop(
        "_slice", "_end", *inputs, *[f"_off_{n}" for n in sums], *[f"_run_{n}" for n in sums]
    )


def positions(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Number rows 1..n along ``order`` within ``keys``."""
    done = running(df, {name: F.lit(1).cast("long")}, order, keys)
    return done.withColumn(name, F.col(name).cast("long"))


def quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per ``keys``."""
    return quantiles_of(df, {value: probs}, keys)


#: Bins per doubling of a value, coarse and fine: a coarse bin spans one part in a hundred, a fine one in a hundred thousand.
LEVELS = (64, 1 << 16)
_OCTAVES = 1100  # doublings from the smallest double to the largest


def histogram_bin(value: Column, per_octave: int) -> Column:
    """A number that never falls as the value grows: bins are even on a logarithmic scale on both sides of zero."""
    size = F.least(F.log2(F.abs(value)), F.lit(_OCTAVES - 1.0)) * per_octave
    place = F.floor(size).cast("long") + _OCTAVES * per_octave
    return F.when(value > 0, place).when(value < 0, -place).otherwise(F.lit(0).cast("long"))


def quantiles_of(
    df: DataFrame, marks: Mapping[str, Mapping[str, float]], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles of several columns per ``keys``: ``marks`` is {column: {name: p}}.

    Nothing is sorted but what is left at the end: rows are collapsed to one per key, column and distinct value, counted in
    coarse bins, and the bins that hold the wanted ranks are counted in fine ones; only the distinct values of those are put
    in order. All keys, columns and ranks go through together. Nulls and NaN are left out; a key without values has no row.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in marks])
    known = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, F.col("_p.c").alias("_column"), F.col("_p.v").alias("_value"))
    counts = known.where(F.col("_value").isNotNull() & ~F.isnan("_value")).groupBy(*keys, "_column", "_value").agg(F.count("*").alias("_n"))
    group = [*keys, "_column"]

    # every wanted rank, from 0, as an entry of its own
    size = F.col("_size")
    ranks = F.lit(None).cast("array<struct<mark:string,high:boolean,rank:bigint>>")
    for column, probs in marks.items():
        entries = []
        for name, p in probs.items():
            spot = F.lit(float(p)) * (size - 1)
            entries += [
                F.struct(F.lit(name).alias("mark"), F.lit(high).alias("high"), cut(spot).cast("long").alias("rank"))
                for high, cut in ((False, F.floor), (True, F.ceil))
            ]
        ranks = F.when(F.col("_column") == column, F.array(*entries)).otherwise(ranks)
    wanted, left = None, counts
    for level, per_octave in enumerate(LEVELS):
        left = left.withColumn("_bin", histogram_bin(F.col("_value"), per_octave))
        by = group if wanted is None else [*group, "_mark", "_high"]
        bins = left.groupBy(*by, *([] if wanted is None else ["_rank", "_size"]), "_bin").agg(F.sum("_n").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(START, 0))
        bins = bins.withColumn("_upto", upto)
        if wanted is None:
            bins = bins.withColumn("_size", F.sum("_n").over(Window.partitionBy(*by)))
            bins = bins.withColumn("_e", F.explode(ranks)).select(
                *group, "_bin", "_n", "_upto", "_size", F.col("_e.mark").alias("_mark"), F.col("_e.high").alias("_high"), F.col("_e.rank").alias("_rank")
            )
        hit = (F.col("_upto") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))
        before = F.col("_rank") - (F.col("_upto") - F.col("_n"))  # the rank inside the bin
        wanted = bins.where(hit).select(*group, "_mark", "_high", "_bin", "_size", before.alias("_rank"))
        if level:
            left = null_safe_join(left.drop("_rank", "_size"), wanted, [*group, "_mark", "_high", "_bin"])
        else:
            left = null_safe_join(left, wanted, [*group, "_bin"])
    upto = F.sum("_n").over(Window.partitionBy(*group, "_mark", "_high").orderBy("_value").rowsBetween(START, 0))
    picked = left.withColumn("_upto", upto).where((F.col("_upto") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
    parts, finals = [], []
    for column, probs in marks.items():
        for name, p in probs.items():
            own = (F.col("_column") == column) & (F.col("_mark") == name)
            spot = F.lit(float(p)) * (size - 1)
            parts += [
                F.max(F.when(own & ~F.col("_high"), F.col("_value"))).alias(f"_lo_{name}"),
                F.max(F.when(own & F.col("_high"), F.col("_value"))).alias(f"_hi_{name}"),
                F.max(F.when(own, spot - F.floor(spot))).alias(f"_part_{name}"),
            ]
            low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
            finals.append(F.when(low == high, low).otherwise(low + (high - low) * F.col(f"_part_{name}")).alias(name))
    return picked.groupBy(*keys).agg(*parts).select(*keys, *finals)


def bounded_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """The same for frames that the calendar bounds, such as daily or monthly series: one aggregate, no ordering."""
    marks = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()]))
    found = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(marks.alias("_marks"))
    return found.select(*keys, *[F.col("_marks")[i].alias(n) for i, n in enumerate(probs)])


def percent_ranks(
    df: DataFrame, value: str, name: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Add the average-method percentile rank of ``value`` (null stays null)."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_ties"))
    )
    placed = running(counts, {"_upto": F.col("_ties")}, [F.col(value)], keys, {"_upto": "_size"})
    average = F.col("_upto") - (F.col("_ties") - 1) / F.lit(2.0)
    ranks = placed.select(*keys, value, (average / F.col("_size")).alias(name))
    return null_safe_join(df, ranks, [*keys, value], "left")


def percent_rank_over(value: Column, keys: Sequence[str] = ()) -> Column:
    """Average-method percentile rank for frames that are already bounded."""
    group = Window.partitionBy(*keys)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    rank = F.rank().over(group.orderBy(value.asc_nulls_last()))
    average = rank + (ties - 1) / F.lit(2.0)
    return F.when(value.isNotNull(), average / F.count(value).over(group))


def average_rank_over(value: Column, keys: Sequence[str] = ()) -> Column:
    """Average-method rank, the numerator of the percentile rank."""
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(value.asc_nulls_last()))
    return F.when(value.isNotNull(), rank + (ties - 1) / F.lit(2.0))

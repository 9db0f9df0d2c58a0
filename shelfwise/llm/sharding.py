"""Sharding by a permutation-filled lookup table (Eisenbud et al., 2016).

Every shard has a preference order over the slots of a table of prime size: an offset and a step from its name's hash.
The shards take turns, each claiming its next free slot, until the table is full. A document's hash names a slot, the
slot its shard. Adding or removing a shard moves few slots of the others.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.hashing import hash52
from shelfwise.llm.names import named, numbered, of

#: Shards, and slots of the table: a prime of at least a hundred times as many.
SHARDS, SLOTS = 64, 8191
#: Largest table, which bounds what is broadcast.
MOST_SLOTS = 1 << 20
#: Seed of the placement.
SEED = 31


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For every slot the position of its shard in ``shards``."""
    if slots > MOST_SLOTS or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime up to {MOST_SLOTS}")
    if not shards or len(shards) > slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, at most as many as slots")
    place = [_number(f"{name}:offset") % slots for name in shards]
    step = [_number(f"{name}:step") % (slots - 1) + 1 for name in shards]
    table, left = [-1] * slots, slots
    while left:
        for shard in range(len(shards)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % slots
            table[place[shard]] = shard
            left -= 1
            if not left:
                break
    return table


def slots_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard): a fixed number of rows, whatever the data."""
    table = json.dumps(lookup_table(shards, slots))
    return spark.range(1).select(F.posexplode(F.from_json(F.lit(table), "array<int>")).alias("slot", "shard"))


def names(count: int) -> list[str]:
    return [f"shard-{k}" for k in range(count)]


def placed(docs: DataFrame, shards: list[str] | None = None, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (position in ``shards``), placed by doc_id; no row is shuffled.

    Rows with equal ids get one shard, a null id has its own fixed slot. Columns named slot or shard, in any case, are replaced.
    """
    shards = names(SHARDS) if shards is None else shards
    slot = (hash52(F.lit(seed), of(docs, "doc_id")) % slots).cast("int")
    rows = numbered(docs).withColumn("slot", slot).join(F.broadcast(slots_frame(docs.sparkSession, shards, slots)), "slot")
    return rows.select(*named(docs, ("slot", "shard")), "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: list[str] | None = None, slots: int = SLOTS, files: int = 4) -> None:
    """Write ``docs`` by shard, each shard spread over ``files`` tasks so that a large one is split."""
    rows = placed(docs, shards, slots)
    part = F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns]), F.lit(files))
    rows.repartition("shard", part).write.partitionBy("shard").parquet(path)


SHARD_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i AS shard, ('0x' || substr(md5('shard-' || i || ':offset'), 1, 13))::BIGINT % {SLOTS} AS place,
         ('0x' || substr(md5('shard-' || i || ':step'), 1, 13))::BIGINT % {SLOTS - 1} + 1 AS step
  FROM range({SHARDS}) t(i)),
fill(turn, slot, shard, taken) AS (
  SELECT 0, (SELECT place FROM shards WHERE shard = 0), 0,
         set_bit(repeat('0', {SLOTS})::BIT, (SELECT place FROM shards WHERE shard = 0)::INT, 1)
  UNION ALL
  SELECT turn, slot, shard, set_bit(taken, slot::INT, 1) FROM (
    SELECT f.turn + 1 AS turn, s.shard::INT AS shard, f.taken,
           list_filter(list_transform(range({SLOTS}), lambda j: (s.place + j * s.step) % {SLOTS}), lambda x: get_bit(f.taken, x::INT) = 0)[1] AS slot
    FROM fill f JOIN shards s ON s.shard = (f.turn + 1) % {SHARDS} WHERE f.turn + 1 < {SLOTS}))
SELECT d.*, fill.slot::INT AS slot, fill.shard AS shard
FROM documents d JOIN fill ON fill.slot = ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT % {SLOTS}
"""

"""Quality, mixing, sharding, quotations and the pipeline."""

import collections
import random

import duckdb
import numpy as np
import plain
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from shelfwise.llm import decontaminate, mixing, quality, queries, quotations, sharding

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def same_as_sql(frame, sql, **tables):
    db = duckdb.connect()
    for name, table in tables.items():
        db.register(name, table if isinstance(table, pa.Table) else table.toArrow())
    cursor = db.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = collections.Counter(tuple(r[columns.index(c)] for c in frame.columns) for r in cursor.fetchall())
    got = collections.Counter(map(tuple, frame.collect()))
    assert got == want
    return got


def words(draw, count):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(count))


@pytest.fixture(scope="module")
def labelled(spark):
    """Good prose, bad shouting, some of it labelled; labels that contradict each other or name no document."""
    draw = random.Random(2)
    rows = [(i, words(draw, 60) if i % 5 else words(draw, 60).upper().replace(" ", "!! "), f"s{i % 3}") for i in range(300)]
    rows += [(300, None, "s0"), (301, "", None), (None, words(draw, 60), "s1"), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("score", F.lit("x"))
    labels = [(i, int(i % 5 > 0), 0) for i in range(0, 300, 2)] + [(1, 0, 0), (1, 1, 0), (999, 1, 0), (None, 1, 0), (3, None, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_parts_held_out_documents(labelled):
    docs, labels = labelled
    kept = quality.sampled(docs, labels).collect()
    ids = {r.doc_id for r in kept if r.doc_id is not None and r.doc_id < 300}
    held = [i for i in range(300) if i % 2]
    right = sum((i in ids) == (i % 5 > 0) for i in held)
    assert right >= 0.97 * len(held)
    rows = quality.resampled(docs, labels)
    assert rows.columns == docs.columns
    assert collections.Counter(r.doc_id for r in rows.collect()) == collections.Counter(r.doc_id for r in kept)


def test_quality_without_labels_keeps_all(labelled):
    docs, labels = labelled
    assert quality.sampled(docs, labels.where("quality = 1")).count() == docs.count()
    assert quality.resampled(docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    values = [5.0, 5.0, 1.0, 9.0, -2.0, 5.0, 8.5]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert [quality.kth_largest(frame, "v", k) for k in range(1, 8)] == sorted(values, reverse=True)
    many = spark.range(20_000).select(F.rand(3).alias("v"))
    want = np.sort(many.toPandas()["v"].to_numpy())[::-1]
    assert quality.kth_largest(many, "v", 7001) == want[7000]


def test_mixing_matches_sql_and_targets(spark, labelled):
    docs = labelled[0].drop("score").withColumn("copy", F.lit(0))
    got = mixing.mixed(docs)
    assert set(got.columns) == {"doc_id", "text", "source", "copy", "shuffle_key"}
    same_as_sql(got, mixing.MIX_SQL.replace("SELECT * EXCLUDE (times)", "SELECT * EXCLUDE (times, copy)").replace("d.*", "d.*"), documents=docs)
    assert mixing.mixed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rate", [0.01, 0.7, 3.0, 399.0, 401.0, 30_000.0])
def test_distributions_are_poisson(spark, rate):
    row = mixing.distributions(spark.createDataFrame([("s", rate)], "source string, rate double")).first()
    mass = np.diff(np.concatenate([[0.0], row.cdf]))
    k = row.first + np.arange(len(mass))
    assert abs(mass.sum() - 1) < 1e-9
    assert abs((mass * k).sum() - rate) < 1e-6 * max(1, rate)
    assert abs((mass * (k - rate) ** 2).sum() - rate) < 1e-5 * max(1, rate)


def test_weights_decide_the_shares(spark):
    rows = [(i, "x" * 50, "big" if i % 10 else "small") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: r.n for r in mixing.mixed(docs, {"big": 1.0, "small": 3.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["small"] - 3750) < 400 and abs(got["big"] - 1250) < 200
    assert {r.source for r in mixing.mixed(docs, {"small": 1.0}, epochs=0.1).select("source").distinct().collect()} == {"small"}


def test_sharding(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(500)] + [(None, None), (1, "t")], "doc_id long, text string").withColumn("slot", F.lit("x"))
    got = sharding.placed(docs)
    assert got.columns == ["doc_id", "text", "slot", "shard"] and got.count() == 502
    assert got.where("doc_id = 1").select("shard").distinct().count() == 1
    assert sharding.placed(docs.limit(0)).count() == 0
    names = sharding.names(64)
    table = sharding.lookup_table(names)
    sizes = collections.Counter(table)
    assert len(sizes) == 64 and max(sizes.values()) - min(sizes.values()) <= 1
    less = sharding.lookup_table(names[:-1])
    assert sum(a != b for a, b in zip(table, less) if a != 63) < 0.05 * len(table)
    for bad in ((["a", "a"], 7), ([], 7), (["a"], 8), (list("abc"), 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_written_shards(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(docs, str(tmp_path / "out"), ["a", "b", "c"], 307)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 3


def talk(draw):
    """Conversations whose messages quote earlier ones at one level or two."""
    said = ["hello there", "how are you", "fine thanks", "yes", "no way"]
    rows = []
    for c in range(25):
        past = []
        for t in range(draw.randint(1, 7)):
            lines = []
            for _ in range(draw.randint(0, 3)):
                if past and draw.random() < 0.6:
                    mark = draw.choice([">", "> ", ">> ", "> > "])
                    lines += [mark + x for x in draw.choice(past).split("\n")]
                else:
                    lines.append(draw.choice(said) + draw.choice(["", " ", f" x{draw.randint(0, 9)}"]))
                if draw.random() < 0.2:
                    lines.append("")
            text = draw.choice(["\n", "\r\n"]).join(lines) if draw.random() < 0.95 else None
            past.append("\n".join(x for x in lines if not x.startswith(">")) or "zz")
            rows.append((c or None, t if t < 6 else None, "user", text))
    return rows + rows[9:12]


def test_quotations_match_sql(spark):
    frame = spark.createDataFrame(talk(random.Random(5)), "conv_id long, turn long, role string, text string")
    got = same_as_sql(quotations.conversations(frame), quotations.QUOTE_SQL, conversations=frame)
    assert any(r[6] > 0 for r in got)
    assert quotations.conversations(frame.limit(0)).count() == 0


def test_quotations_by_hand(spark, monkeypatch):
    monkeypatch.setattr(quotations, "BUCKET", 2)
    rows = [(1, 0, "a", "Same words"), (1, 1, "b", "other"), (1, 5, "c", "same  WORDS\n"), (1, 9, "d", "> Same words\nI agree"), (1, 10, "e", "> I agree\n>> same words\nok")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.text, r.parent_turn, r.thread_turn, r.depth, r.n_quotes) for r in quotations.conversations(frame).collect()}
    assert got[9] == ("I agree", 5, 5, 1, 1)
    assert got[10] == ("ok", 9, 5, 2, 2)
    assert got[5][1:] == (None, 5, 0, 0)


def test_quality_matches_a_plain_version(labelled):
    docs, labels = labelled
    docs, labels = docs.where("doc_id IS NOT NULL"), labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain.importance_resampled(rows, [(r.doc_id, r.quality) for r in labels.collect()], quality.BUCKETS, quality.SEED)
    assert 0 < len(want) < len(rows)
    assert sorted(r.doc_id for r in quality.sampled(docs, labels).collect()) == sorted(want)


def test_pipeline_matches_a_plain_version(spark):
    """Plain resampling, all pairs, all edit distances, then SQL for the copies and their shards."""
    tables = {t: pq.read_table(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    texts = dict(zip(*(tables["documents"].column(c).to_pylist() for c in ("doc_id", "text"))))
    assert len(texts) == tables["documents"].num_rows
    said = zip(*(tables["labels"].column(c).to_pylist() for c in ("doc_id", "quality")))
    good = plain.importance_resampled(list(texts.items()), said, quality.BUCKETS, quality.SEED)
    near = plain.near_components([(i, texts[i]) for i in good])
    alone = [i for i in good if near[i] == i or not texts[i]]
    items = [decontaminate.normalised(t) for t in tables["benchmark"].column("text").to_pylist()]
    leaks = {
        i for i in alone for text in [decontaminate.normalised(texts[i])]
        if any(plain.part_distance(item, text) <= decontaminate.budget(len(item)) for item in items)
    }
    left = [i for i in alone if i not in leaks]
    assert len(texts) > len(good) > len(alone) > len(left) > 0
    db = duckdb.connect()
    db.register("documents", tables["documents"].filter(pc.is_in(tables["documents"]["doc_id"], pa.array(left))))
    columns = ", ".join(tables["documents"].column_names)
    copies = db.execute(f"SELECT {columns} FROM ({mixing.MIX_SQL})").to_arrow_table()
    db.unregister("documents")
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == [*tables["documents"].column_names, "slot", "shard"]
    same_as_sql(got, sharding.SHARD_SQL, documents=copies)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    table = {"op2": "conversations"}.get(name.split("_")[0], "documents")
    same_as_sql(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], **{table: spark.read.parquet(f"{SMALL}/{table}.parquet")})

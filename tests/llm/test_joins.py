"""Near copies, decontamination, neighbours and components."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from shelfwise.llm import decontaminate, hnsw, jaccard, textnp
from shelfwise.llm.components import components

from plain import edit_distance, near_components, shingles


def test_shingle_sets_match_plain_sets():
    draw = random.Random(1)
    texts = [None, "", " ", "a", "A b", "a b c d e f", "a  b\tc\nd E", "é x y z w  é X"]
    texts += ["".join(draw.choice("ab \n\tÉ") for _ in range(draw.randint(0, 60))) for _ in range(500)]
    seen = {}
    for text, got in zip(texts, textnp.shingle_sets(pa.array(texts))):
        want = shingles(text)
        assert len(got) == len(want)
        assert seen.setdefault(want, frozenset(map(int, got))) == frozenset(map(int, got))
    assert len(set(seen.values())) == len(seen)


def near_documents():
    """Families of near copies, a long chain, exact copies and a passage many documents share."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    shared = " ".join(word() for _ in range(30))
    docs = [(0, None), (1, ""), (2, "One two"), (3, "one  TWO"), (4, "one"), (5, " \n ")]
    for _ in range(12):
        base = [word() for _ in range(draw.choice([6, 40, 120]))]
        for _ in range(draw.randint(1, 6)):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 25))):
                text[draw.randrange(len(text))] = word()
            docs.append((len(docs), " ".join(text)))
        docs.append((len(docs), shared + " " + " ".join(word() for _ in range(draw.choice([4, 60])))))
    text = [word() for _ in range(80)]
    for _ in range(25):
        text = text[2:] + [word(), word()]
        docs.append((len(docs), " ".join(text)))
    docs += [(len(docs) + k, docs[8][1]) for k in range(8)]
    draw.shuffle(docs)
    return docs


def test_jaccard_components_match_all_pairs(spark):
    docs = near_documents()
    rows = [(t, i, -1) for i, t in docs] + [("one two", None, 0), (docs[0][1], docs[0][0], 0)]
    frame = spark.createDataFrame(rows, "text string, doc_id long, component_id long").repartition(3)
    want = near_components(docs)
    got = jaccard.jaccard_components(frame).collect()
    assert len(got) == len(rows)
    sizes = {i: len(shingles(t)) for i, t in docs}
    for row in got:
        if row.doc_id is not None:
            assert (row.n_shingles, row.component_id) == (sizes[row.doc_id], want[row.doc_id])
        else:
            assert row.component_id is None
    assert len(set(want.values())) < len(want)
    kept = jaccard.one_per_component(frame)
    assert kept.columns == frame.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i))
    assert ids == sorted({c for c in want.values()}) + [None]


@pytest.mark.parametrize("highest", [0, 1])
def test_sets_beyond_the_largest_coordinate_keep_their_links(spark, monkeypatch, highest):
    monkeypatch.setattr(jaccard, "HIGHEST", highest)
    docs = near_documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame).collect()}
    assert got == near_components(docs)


def test_jaccard_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty).collect() == []


@pytest.mark.parametrize("highest", [jaccard.HIGHEST, 1])
def test_tree_finds_all_pairs_that_pass_the_bounds(highest):
    draw = np.random.default_rng(3)
    base = draw.poisson(2, (40, jaccard.GROUPS))
    points = np.concatenate([base, np.maximum(base + draw.integers(-1, 2, base.shape) * (draw.random(base.shape) < 0.1), 0)]).astype(np.uint16)
    sizes, labels = points.sum(axis=1).astype(np.int64), np.arange(80)
    clipped = np.minimum(points, highest)
    q, e, _ = jaccard.Tree(clipped, sizes, labels).search(clipped, sizes, labels)
    got = {(a, b) for a, b in zip(q.tolist(), e.tolist())}
    for a in range(80):
        for b in range(80):
            small, large = sorted((int(sizes[a]), int(sizes[b])))
            fits = 100 * small >= 75 * large and np.minimum(points[a], points[b]).sum(dtype=int) >= -(-3 * (small + large) // 7)
            if fits and a != b:
                assert (a, b) in got


@pytest.mark.parametrize("edges_of_a_task", [100_000, 20])
def test_components_of_chains_and_stars(spark, monkeypatch, edges_of_a_task):
    monkeypatch.setattr("shelfwise.llm.components.TASK_EDGES", edges_of_a_task)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 20)] + [(3, 3), (None, 4), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in range(7, 20)}


def test_decontamination_matches_edit_distances():
    draw, letters = random.Random(3), "abcde "
    items = [(k, "".join(draw.choice(letters) for _ in range(draw.choice([5, 20, 40, 60, 90])))) for k in range(12)]
    index = decontaminate.Items(items + [(50, None), (51, "  "), (None, "abc")], decontaminate.EDIT_RATE)
    found = 0
    for _ in range(60):
        text = list(decontaminate.normalised(draw.choice(items)[1]))
        for _ in range(draw.randint(0, len(text) // 8)):
            at = draw.randrange(len(text))
            text[at : at + draw.randint(0, 1)] = draw.choice(letters) * draw.randint(0, 1)
            text = text or ["a"]
        rest = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(0, 50)))
        text = decontaminate.normalised(rest() + "".join(text) + rest())
        want = {}
        for item, passage in items:
            passage = decontaminate.normalised(passage)
            edits = edit_distance(passage, text)
            if passage and edits <= decontaminate.budget(len(passage)):
                want[item] = edits
        assert {item: edits for _, item, edits, _, _ in index.matches(["zz", text, ""])} == want
        found += len(want)
    assert found > 20


def test_contaminated_rows(spark):
    passage = "The quick brown fox jumps over the lazy dog and runs away from all the noise"
    rows = [(1, "x " + passage.upper() + " y", 9), (1, "x " + passage.upper() + " y", 9), (2, "clean text", 9), (None, passage, 9), (3, None, 9), (4, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(5, passage, "z"), (6, None, "z"), (None, "clean text", "z")], "item_id long, text string, doc_id string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.edits, r.start_char) for r in got), key=repr) == [(1, 5, 0, 2), (1, 5, 0, 2), (None, 5, 0, 0)]
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(docs.limit(0), bench).collect() == []


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(5)
    points = draw.normal(size=(900, 16))
    points[300:600] = points[7]
    return points


def test_neighbours_recall_and_order(spark, vectors):
    rows = [(i, [float(x) for x in v], 0.0) for i, v in enumerate(vectors)]
    rows += [(901, None, 0.0), (902, [0.0] * 16, 0.0), (903, [float("nan")] * 16, 0.0), (904, [None] * 16, 0.0), (None, [1.0] * 16, 0.0), rows[50]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = hnsw.nearest(frame, hnsw.every_fiftieth(frame), shard_rows=250).collect()
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for query in range(0, 900, 50):
        mine = sorted((r for r in got if r.query_id == query), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        scores = units @ units[query]
        scores[query] = -9
        best = np.lexsort((np.arange(900), -np.round(scores, 12)))[:5]
        hits += len({r.vec_id for r in mine} & set(best.tolist()))
        assert all(abs(r.score - scores[r.vec_id]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
    assert hits >= 0.95 * 90
    assert [r.vec_id for r in got if r.query_id == 300] == [7, 301, 302, 303, 304]


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = hnsw.nearest(frame, hnsw.every_fiftieth(frame)).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2)]
    assert hnsw.nearest(frame.limit(0), frame.limit(0)).collect() == []
    assert hnsw.nearest(frame, frame.where(F.lit(False))).collect() == []

"""N-gram Jaccard join by count vectors in R-trees.

The tokens (word shingles) of a document are hashed into ``GROUPS`` groups; the group counts are a point.
The overlap of two documents is at most the sum of the coordinate minima of their points, and of a document
and an R-tree node at most that sum with the node's largest coordinates. Coordinates end at ``HIGHEST``; what a set
holds beyond that in all its groups, its excess, is its size without its coordinates' sum, and two sets share at
most the smaller excess there.

In running text all points lie close together, so one tree over everything would visit every leaf. The points
are therefore dealt first by rare coordinates: two sets with a similarity of 3/4 share at least k shingles among the
first ``n - ceil(3n/4) + k`` of each in any common order. Shingles found in many documents come last in that
order, the others follow their hash. Each shared shingle is a cell. A set that shares fewer cells than the k of its
smallest possible partner has no partner and leaves all its cells; an R-tree is built inside each cell that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import textnp
from shelfwise.llm.components import components
from shelfwise.llm.storage import stored
from shelfwise.sources.session import bounded_batches

#: Groups of the count vectors.
GROUPS = 512
#: Largest coordinate of a point.
HIGHEST = np.iinfo(np.uint16).max
#: Shingles of a prefix that linked sets share beyond the first, per shingle of the set.
SPARE = 0.08
#: Entries of an R-tree node.
FANOUT = 16
#: Members of a cell that are compared as one block; larger cells are cut into pairs of blocks.
BLOCK = 1024
#: Two sets are linked when PART * overlap >= WHOLE * union.
PART, WHOLE = 100, 75
#: Most frequent shingles that are put last; only the order depends on it, never the result.
MOST_FREQUENT = 1 << 20
#: Shingles that are counted at once for that.
TALLIED = 1 << 20
#: Pairs of a point and a node or entry whose minima are added up at once.
PAIRS = 1 << 12
#: Bits of the document filter that is sent to the tasks.
FILTER_BITS = 1 << 26


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The overlap two linked sets of sizes ``a`` and ``b`` have at least: overlap >= 3/7 (a + b)."""
    return -((-(a + b) * WHOLE) // (PART + WHOLE))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles in many documents: counted in all of them, some thousands of documents at once first; sorted."""
    spark = docs.sparkSession

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for values in textnp.shingle_sets(batch.column(0)):
                parts.append(values)
                held += len(values)
                if held >= TALLIED:
                    yield tally(parts)
                    parts, held = [], 0
        if parts:
            yield tally(parts)

    def tally(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        often = counts >= 2
        return pa.RecordBatch.from_arrays(
            [pa.array(_signed(values[often])), pa.array(counts[often].astype(np.int64))], names=["h", "n"]
        )

    counts = stored(
        docs.select("text").mapInArrow(tallies, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 64")
    )
    least = 64
    while (found := counts.where(F.col("n") >= least)).count() > MOST_FREQUENT:
        least *= 2
    values = np.array([r.h for r in found.select("h").toLocalIterator()], dtype=np.int64)
    return np.sort(values.view(np.uint64))


def _points(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Per document: its set's key and size, its point, and the shingles of its prefix.

    A task gives the prefix of equal sets once only."""
    last = docs.sparkSession.sparkContext.broadcast(frequent)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in textnp.pieces(batches, 1):
            keys, sizes, vectors, prefixes = [], [], [], []
            for values in textnp.shingle_sets(batch.column(1)):
                n = len(values)
                key = int(_signed(textnp.set_key(values).reshape(1))[0])
                keys.append(key)
                sizes.append(n)
                counts = np.bincount((values >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
                vectors.append(np.minimum(counts, HIGHEST).astype(np.uint16))
                prefix = values[:0]
                if n and key not in seen:
                    seen.add(key)
                    keep = n + (-n * WHOLE // PART) + 1 + int(n * SPARE)
                    prefix = values[:keep]
                    if len(last.value):
                        at = np.minimum(np.searchsorted(last.value, values), len(last.value) - 1)
                        often = last.value[at] == values
                        prefix = np.concatenate([values[~often], values[often]])[:keep]
                prefixes.append(_signed(prefix))
            flat = np.concatenate(vectors) if vectors else np.zeros(0, dtype=np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(keys, type=pa.int64()),
                    pa.array(sizes, type=pa.int64()),
                    textnp.binary(flat, np.arange(len(keys) + 1) * (2 * GROUPS)),
                    textnp.lists(prefixes, pa.int64()),
                ],
                names=["doc_id", "key", "n", "point", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        build, "doc_id long, key long, n long, point binary, prefix array<long>"
    )


def _cells(points: DataFrame) -> DataFrame:
    """Members (cell, key, tag, times) of the cells with two sets or more, and of those that a task boundary cuts.

    The first shingle that two linked sets share lies among the first ``n - ceil(6n/7) + 1`` of the smaller (tag 2) and
    the first ``n - ceil(3n/4) + 1`` of the larger (tag 1 or 2). Equal cells get one name, made from their members, and
    the larger tags; ``times`` counts them."""
    early = lambda part, whole: F.col("pos") <= F.col("n") - F.ceil(F.col("n") * part / whole)
    rows = (
        points.where("size(prefix) > 0")
        .select(F.posexplode("prefix").alias("pos", "cell"), "key", "n")
        .select("cell", "key", F.when(early(2 * WHOLE, PART + WHOLE), 2).when(early(WHOLE, PART), 1).otherwise(0).cast("long").alias("tag"))
        .repartitionByRange("cell", "key")
        .sortWithinPartitions("cell", "key")
    )

    def members(rows: np.ndarray, cut: bool) -> pa.RecordBatch:
        """Of sorted rows (cell, key, tag); ``cut``: more rows of these cells may lie elsewhere."""
        name, keys, tags = rows[:, np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])]
        begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        count = np.diff(np.append(begin, len(name)))
        if not cut:
            mixed = textnp.mix(keys.view(np.uint64) + np.uint64(0x51ED270B27B4C5A3))
            name = np.repeat(_signed(textnp.mix(np.add.reduceat(mixed, begin) + count.astype(np.uint64))), count)
            many = np.repeat(count > 1, count)
            name, keys, tags = name[many], keys[many], tags[many]
        order = np.lexsort((-tags, keys, name))
        name, keys, tags = name[order], keys[order], tags[order]
        first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (keys[1:] != keys[:-1])])[: len(name)])
        times = np.diff(np.append(first, len(name)))
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (name[first], keys[first], tags[first], times)], names=["cell", "key", "tag", "times"]
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, first = np.zeros((3, 0), dtype=np.int64), True
        for batch in batches:
            rows = np.concatenate([rows, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if first and rows.shape[1]:  # the first cell may go on from the task before
                whole = int(np.searchsorted(rows[0], rows[0, 0], side="right"))
                if whole < rows.shape[1] or whole > 8 * BLOCK:
                    yield members(rows[:, :whole], True)
                    first, rows = whole == rows.shape[1], rows[:, whole:]
            if not first and rows.shape[1]:
                whole = int(np.searchsorted(rows[0], rows[0, -1], side="left"))
                if whole:
                    yield members(rows[:, :whole], False)
                elif rows.shape[1] > 8 * BLOCK:  # a very large cell: in pieces, which meet by its name
                    yield members(rows, True)
                    whole, first = rows.shape[1], True
                rows = rows[:, whole:]
        if rows.shape[1]:
            yield members(rows, True)

    found = rows.mapInArrow(scan, "cell long, key long, tag long, times long")
    return found.groupBy("cell", "key").agg(F.max("tag").alias("tag"), F.sum("times").alias("times"))


def _possible(members: DataFrame, points: DataFrame) -> DataFrame:
    """The members that share as many cells as any partner would ask for, in the cells where a link must show."""
    least = F.lit(1) + F.floor(F.ceil(F.col("n") * WHOLE / PART) * SPARE)
    full = members
    for last in (False, True):
        enough = full.groupBy("key").agg(F.sum("times").alias("shared")).join(points.select("key", "n"), "key")
        full = full.join(enough.where(F.col("shared") >= least).select("key"), "key", "left_semi")
        if last:
            full = full.where("tag > 0")
        cells = full.groupBy("cell").agg(F.count("*").alias("sets"), F.max("tag").alias("early"))
        cells = stored(cells.where("sets > 1" + " AND early = 2" * last).select("cell"))  # so AQE can split large cells
        full = stored(full.join(cells, "cell", "left_semi"))
    return full.select("cell", "key")


def _neighbours(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that follow each other in a cell, as far as one task sees them."""
    rows = members.repartitionByRange("cell", "key").sortWithinPartitions("cell", "key")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((2, 0), dtype=np.int64)
        for batch in batches:
            both = np.concatenate([last, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])], axis=1)
            if both.shape[1]:
                at = np.flatnonzero(both[0, 1:] == both[0, :-1])
                pair = np.unique(np.stack([both[1, at], both[1, at + 1]]), axis=1)
                last = both[:, -1:]
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    return rows.mapInArrow(follow, "a long, b long").distinct()


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and summed coordinate minima allow a link."""
    left = points.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("p_a"))
    right = points.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("p_b"))
    sized = pairs.join(left, "a").join(right, "b")
    sized = sized.where(
        (F.lit(PART) * F.least("n_a", "n_b") >= F.lit(WHOLE) * F.greatest("n_a", "n_b"))
    ).select("a", "b", "n_a", "n_b", "p_a", "p_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (_vectors(batch.column(k)) for k in (4, 5))
            n_a, n_b = (batch.column(k).to_numpy() for k in (2, 3))
            most = np.minimum(one, other).sum(axis=1, dtype=np.int64) + np.minimum(_excess(one, n_a), _excess(other, n_b))
            keep = most >= least_overlap(n_a, n_b)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return sized.mapInArrow(check, "a long, b long")


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, GROUPS)


def shared_at_most(points: np.ndarray, p: np.ndarray, others: np.ndarray, o: np.ndarray) -> np.ndarray:
    """The sums of coordinate minima of the pairs of ``points[p]`` and ``others[o]``, ``PAIRS`` at once."""
    out = np.zeros(len(p), dtype=np.int64)
    for at in range(0, len(p), PAIRS):
        part = slice(at, at + PAIRS)
        out[part] = np.minimum(points[p[part]], others[o[part]]).sum(axis=1, dtype=np.int64)
    return out


def _excess(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many shingles of each set its point leaves out."""
    return sizes - points.sum(axis=1, dtype=np.int64)


def _document_filter(ids: DataFrame) -> np.ndarray:
    """A bit set of hashed ids: at most ``FILTER_BITS`` bits whatever the input, collected by words."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    found = (
        ids.select(F.floor(slot / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {FILTER_BITS}) % 64 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in found.toLocalIterator():
        bits[row.word] = row.bits
    return bits


def _sets(docs: DataFrame, points: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, shingles) of the sets whose keys are in ``needed`` (key), from the text of one document each."""
    wanted = stored(points.join(needed.distinct(), "key", "left_semi").select("key", "doc_id"))
    bits = docs.sparkSession.sparkContext.broadcast(_document_filter(wanted))
    slotted = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("slot"), "doc_id", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnp.pieces(batches, 2):
            slot = batch.column(0).to_numpy()
            hit = (bits.value[slot >> 6] >> (slot & 63)) & 1 == 1
            part = batch.filter(pa.array(hit))
            sets = [s for s in textnp.shingle_sets(part.column(2))]
            keys = np.array([textnp.set_key(s) for s in sets], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(1),
                    pa.array(_signed(keys)),
                    textnp.lists([_signed(s) for s in sets], pa.int64()),
                ],
                names=["doc_id", "key", "shingles"],
            )

    built = slotted.where("doc_id IS NOT NULL").mapInArrow(build, "doc_id long, key long, shingles array<long>")
    return built.join(wanted, ["key", "doc_id"], "left_semi").dropDuplicates(["key"]).select("key", "shingles")


def _verified(docs: DataFrame, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough, stored."""
    pairs = stored(pairs)
    needed = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    sets = stored(_sets(docs, points, needed))
    both = (
        pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("s_a")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("s_b")), "b")
        .select("a", "b", F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b"), F.size(F.array_intersect("s_a", "s_b")).alias("shared"))
    )
    return stored(both.where(F.lit(PART) * F.col("shared") >= F.lit(WHOLE) * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b"))


class Tree:
    """An R-tree packed over the points of one block; nodes keep largest coordinates and excess, sizes and components."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0))) if len(points) > FANOUT else 0
        self.order = np.lexsort((points[:, axis], sizes, labels))
        self.levels = []
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        first, last = labels[self.order], labels[self.order]
        more = _excess(top, low)
        while True:
            self.levels.append((top, more, low, high, first, last))
            if len(top) <= FANOUT:
                break
            cut = np.arange(0, len(top), FANOUT)
            top, more = np.maximum.reduceat(top, cut, axis=0), np.maximum.reduceat(more, cut)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            first, last = np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)

    def search(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, entry) of different components that may be linked, with their similarity at most."""
        found_q, found_e, found_s = [np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)], [np.zeros(0)]
        excess = _excess(points, sizes)
        todo = [(len(self.levels) - 1, 0, len(self.levels[-1][0]), np.arange(len(points)))]
        while todo:
            level, begin, end, active = todo.pop()
            top, more, low, high, first, last = (x[begin:end] for x in self.levels[level])
            n = sizes[active][:, None]
            least = np.maximum(low[None, :], -(-n * WHOLE // PART))
            fits = (least <= high[None, :]) & (PART * n >= WHOLE * low[None, :])
            fits &= ~((first == last)[None, :] & (first[None, :] == labels[active][:, None]))
            q, e = np.nonzero(fits)
            if len(q):
                bound = shared_at_most(points, active[q], top, e) + np.minimum(excess[active[q]], more[e])
                ok = bound >= least_overlap(n[q, 0], least[q, e])
                q, e, bound = q[ok], e[ok], bound[ok]
                if level == 0:
                    found_q.append(active[q])
                    found_e.append(self.order[begin + e])
                    found_s.append(bound / (n[q, 0] + low[e] - bound))
            if level == 0:
                continue
            width = len(self.levels[level - 1][0])
            for node in np.unique(e):
                at = (begin + node) * FANOUT
                todo.append((level - 1, at, min(at + FANOUT, width), active[q[e == node]]))
        return np.concatenate(found_q), np.concatenate(found_e), np.concatenate(found_s)


def _tree_pairs(members: DataFrame, points: DataFrame, roots: DataFrame, best: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of different components that share a cell and pass the bounds.

    With ``best`` only each set's so many most promising partners in a block."""
    labelled = stored(
        members.join(roots.withColumnRenamed("node", "key"), "key", "left")
        .select("cell", "key", F.coalesce("root", "key").alias("root"))
    )
    per_root = labelled.groupBy("cell", "root").agg(F.count("*").alias("n"))
    mixed = stored(per_root.groupBy("cell").agg(
        F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n_all"), F.count("*").alias("roots")
    ).where("roots > 1"))
    # The members of a cell's largest component meet only the others; both sides are cut into blocks.
    placed = labelled.join(mixed, "cell").select(
        "cell", "key", "root", (F.col("root") == F.col("major")).alias("is_major"),
        F.ceil(F.col("n_major") / BLOCK).cast("int").alias("majors"),
        F.ceil((F.col("n_all") - F.col("n_major")) / BLOCK).cast("int").alias("others"),
    )
    own = F.pmod(F.xxhash64("key"), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("others"))).cast("int")
    placed = placed.withColumn("own", own)
    # Kinds of block pairs: (-1 - i, j): block i of the largest component with block j of the others; (i, j): others.
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    homes = F.when(
        F.col("is_major"), F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: pair(-1 - F.col("own"), j))
    ).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda i: pair(-1 - i, F.col("own"))),
            F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: pair(F.least(F.col("own"), j), F.greatest(F.col("own"), j))),
        )
    )
    placed = placed.withColumn("home", F.explode(homes)).select("cell", "home.i", "home.j", "key", "root", "is_major")
    full = placed.join(points.select("key", "n", "point"), "key").select("cell", "i", "j", "key", "root", "is_major", "n", "point")
    blocks = full.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def compare(rows: pa.RecordBatch | pa.Table, begin: int, end: int) -> np.ndarray:
        i, keys, roots, side, sizes = (rows.column(c).to_numpy()[begin:end] for c in (1, 3, 4, 5, 6))
        vectors = _vectors(rows.column(7).slice(begin, end - begin))
        e_at = q_at = np.arange(end - begin)
        if i[0] < 0:
            e_at, q_at = np.flatnonzero(side), np.flatnonzero(~side)
        q, e, likely = Tree(vectors[e_at], sizes[e_at], roots[e_at]).search(vectors[q_at], sizes[q_at], roots[q_at])
        apart = roots[q_at[q]] != roots[e_at[e]]
        q, e, likely = q[apart], e[apart], likely[apart]
        if best:
            order = np.lexsort((keys[e_at[e]], -likely, q))
            q, e = q[order], e[order]
            first = np.searchsorted(q, q, side="left")
            top = np.arange(len(q)) - first < best
            q, e = q[top], e[top]
        one, other = keys[q_at[q]], keys[e_at[e]]
        return np.stack([np.minimum(one, other), np.maximum(one, other)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([*(rest or []), batch]).combine_chunks()
            ids = np.stack([rows.column(c).to_numpy() for c in (0, 1, 2)])
            if not ids.shape[1]:
                continue
            begin = np.append(np.flatnonzero(np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(axis=0)])), ids.shape[1])
            found = [compare(rows, a, b) for a, b in zip(begin[:-2], begin[1:-1])]
            rest = rows.slice(int(begin[-2])).to_batches()
            yield from answer(found)
        if rest:
            rows = pa.Table.from_batches(rest).combine_chunks()
            yield from answer([compare(rows, 0, rows.num_rows)])

    def answer(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if found:
            pair = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    return blocks.mapInArrow(search, "a long, b long").distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, n_shingles, component_id): the smallest doc_id reachable over links.

    ``docs`` needs doc_id and text; other columns are ignored. A document's set holds the distinct 5-word
    shingles of its ASCII-lower-cased words; with fewer words the whole sequence is one shingle. Two documents are
    linked when 100 * overlap >= 75 * union. A null or empty text has an empty set and no links: it is its own
    component. Equal sets are one node. Repeated rows are answered once each. A row with a null doc_id takes no
    part and gets a null component. Sets are told apart by 64-bit hashes.

    Rounds: sets that follow each other in a cell are compared first, then each set with its most promising partners; the
    components of these links leave the last round, which compares all pairs still possible, only cells with several
    components. So a group of near copies is not expanded into its pairs.
    """
    spark: SparkSession = bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id IS NOT NULL")
    table = stored(_points(docs, _frequent(known)))
    usable = table.where("doc_id IS NOT NULL AND n > 0")
    points = stored(usable.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("point").alias("point")))
    members = _possible(stored(_cells(usable)), points)
    links = _verified(docs, points, _bounded(_neighbours(members), points))
    for best in (2, None):
        roots = stored(components(links))
        links = links.unionByName(_verified(docs, points, _tree_pairs(members, points, roots, best)))
    roots = stored(components(links))
    ids = points.select("key", "doc_id").join(roots.withColumnRenamed("node", "key"), "key")
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = ids.join(least, "root").select("key", "component_id")
    single = points.select("key", F.col("doc_id").alias("own"))
    found = single.join(linked, "key", "left").select("key", F.coalesce("component_id", "own").alias("found"))
    return table.join(found, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"),
    )


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component; all columns stay.

    Of repeated rows (equal doc_id and text) one stays. Rows with a null doc_id or without words are kept.
    """
    found = jaccard_components(docs).where("doc_id IS NOT NULL AND n_shingles > 0")
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_lost")).distinct()
    rows = docs.where("doc_id IS NOT NULL").join(lost, F.col("doc_id") == F.col("_lost"), "left_anti")
    return rows.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id IS NULL"))

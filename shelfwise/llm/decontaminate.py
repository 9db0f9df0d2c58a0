"""Benchmark decontamination by q-gram lemma filtering.

An occurrence of an item of ``m`` characters with at most ``e`` edits keeps at least ``m + 1 - q (e + 1)`` of the
item's q-grams, all on diagonals (text position minus item position) that differ by at most ``e``. Shared q-grams are
counted in overlapping diagonal bands; bands that reach the bound are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a q-gram.
Q = 8
#: Edits allowed per character of an item.
EDIT_RATE = 0.08
#: Characters of benchmark text that are sent to the tasks at once; a larger benchmark goes in several rounds. Its index takes some 40 bytes
#: a character in every Python worker.
BLOCK_CHARS = 1 << 22
#: Cells of a line of the tables that are aligned at once.
ALIGNED = 1 << 16
#: Characters of documents hashed at once.
CHUNK = 1 << 18
_BITS = 22
_BASE = 0x9E3779B97F4A7C15


def normalised(text: str | None) -> str:
    """Lower case, white space as one space, none at the ends."""
    return " ".join((text or "").lower().replace("\x00", " ").split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _qgrams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all ``Q`` = 8 consecutive codes, by doubling."""
    out, base = codes * np.uint64(0xBF58476D1CE4E5B9) ^ (codes << np.uint64(17)), _BASE
    width = 1
    while width < Q:
        out = out[:-width] * np.uint64(base) + out[width:]
        base, width = base * base % (1 << 64), 2 * width
    out ^= out >> np.uint64(29)
    return out * np.uint64(0x94D049BB133111EB)


def budget(length: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed for an item: ``rate`` of its characters, or fewer if the lemma needs that to say anything."""
    return max(0, min(int(length * rate), (length + 1) // Q - 1))


def aligned_many(items: list[np.ndarray], text: np.ndarray, lows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each item against any part of ``text`` on ``width`` diagonals from its ``lows`` on: edits, starts, ends.

    All items go through the table together, a row for each; those that have ended keep their last line."""
    unit, far = 1 << 32, 1 << 60
    lengths = np.array([len(i) for i in items])
    order = np.argsort(-lengths, kind="stable")  # the ones still running come first
    sizes, n = lengths[order], len(text)
    codes = np.zeros((int(sizes[0]), len(items)), dtype=np.uint64)
    for place, which in enumerate(order):
        codes[: sizes[place], place] = items[which]
    k = np.arange(width)
    base = lows[order].astype(np.int64)[:, None] + k
    rows = np.where((base >= 0) & (base <= n), base, far)
    ramp = k * unit
    padded = np.append(text, np.uint64(0))
    running = len(items)
    for i in range(1, len(codes) + 1):
        while sizes[running - 1] < i:
            running -= 1
        at = base[:running] + i
        row = rows[:running]
        inside, known = (at >= 1) & (at <= n), (at >= 0) & (at <= n)
        same = inside & (padded[np.clip(at - 1, 0, n)] == codes[i - 1, :running, None])
        best = np.where(inside, row + np.where(same, 0, unit), far)
        skip = np.concatenate([row[:, 1:], np.full((running, 1), far)], axis=1) + unit
        best = np.minimum(best, np.where(known, skip, far))
        best = np.minimum(np.minimum.accumulate(best - ramp, axis=1) + ramp, far)
        rows[:running] = np.where(known, best, far)
    ends = np.argmin(rows, axis=1)
    least = rows[np.arange(len(items)), ends]
    edits, starts, stops = np.empty(len(items), dtype=np.int64), np.empty(len(items), dtype=np.int64), np.empty(len(items), dtype=np.int64)
    edits[order], starts[order] = least >> 32, least & (unit - 1)
    stops[order] = sizes + base[:, 0] + ends
    return edits, starts, stops


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Least edits of one ``item`` against any part of ``text`` on the diagonals low..high: (edits, start, end)."""
    edits, starts, ends = aligned_many([item], text, np.array([low]), high - low + 1)
    return int(edits[0]), int(starts[0]), int(ends[0])


def whole_words(text: str, item: str) -> int:
    """The first place of ``item`` in ``text`` that no letter or digit goes on from; -1 without one."""
    at = text.find(item)
    while at >= 0:
        end = at + len(item)
        if not (at and item[0].isalnum() and text[at - 1].isalnum()) and not (end < len(text) and item[-1].isalnum() and text[end].isalnum()):
            return at
        at = text.find(item, at + 1)
    return -1


class Items:
    """The q-gram index of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        items = sorted({(i, t) for i, text in items if i is not None and (t := normalised(text))})
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.short = [k for k, t in enumerate(self.texts) if len(t) < Q]
        self.codes = [_codes(t) for t in self.texts]
        self.edits = np.array([budget(len(t), rate) for t in self.texts], dtype=np.int64)
        self.least = np.array([len(t) + 1 - Q * (e + 1) for t, e in zip(self.texts, self.edits)], dtype=np.int64)
        grams = [_qgrams(c) if len(c) >= Q else c[:0] for c in self.codes]
        which = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, dtype=int)
        flat = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, self.which, self.place = flat[order], which[order], place[order]
        self.values, self.begin = np.unique(flat, return_index=True)
        self.count = np.diff(np.append(self.begin, len(flat)))
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[(self.values >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.needed = int(self.least[self.least > 0].min()) if len(flat) else 0

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item id, edits, start, end) of each item found in each of ``texts``: its best place."""
        if self.short:
            for row, text in enumerate(texts):
                for k in self.short:
                    if (at := whole_words(text, self.texts[k])) >= 0:
                        yield row, self.ids[k], 0, at, at + len(self.texts[k])
        if not len(self.values):
            return
        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes)
        codes = _codes("\x00".join(texts) + "\x00" * Q)
        grams = _qgrams(codes)
        hit = np.flatnonzero(self.bitmap[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        hit = hit[hit < ends[-1]]
        at = np.minimum(np.searchsorted(self.values, grams[hit]), len(self.values) - 1)
        real = self.values[at] == grams[hit]
        hit, at = hit[real], at[real]
        rows = np.searchsorted(ends, hit, side="right")
        edges = np.searchsorted(rows, np.arange(len(texts) + 1))
        for row in np.flatnonzero(np.diff(edges) >= self.needed):
            a, b = edges[row], edges[row + 1]
            start = int(ends[row] - sizes[row])
            for item, edits, low, high in self._verified(hit[a:b] - start, at[a:b], codes[start : int(ends[row]) - 1], texts[row]):
                yield int(row), self.ids[item], edits, low, high

    def _verified(self, hit: np.ndarray, at: np.ndarray, codes: np.ndarray, text: str) -> Iterator[tuple[int, int, int, int]]:
        count = self.count[at]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        post = np.repeat(self.begin[at], count) + step
        item, diagonal = self.which[post], np.repeat(hit, count) - self.place[post]
        enough = np.bincount(item, minlength=len(self.ids)) >= self.least
        keep = enough[item]
        item, diagonal = item[keep], diagonal[keep]
        if not len(item):
            return
        step = self.edits[item] + 1
        band = np.floor_divide(diagonal, step)
        shift = 1 << 31
        key = np.concatenate([(item << 32) + band + shift, (item << 32) + band - 1 + shift])  # bands two steps wide
        keys, counts = np.unique(key, return_counts=True)
        which = keys >> 32
        good = counts >= self.least[which]
        best: dict[int, tuple[int, int, int]] = {}
        exact: dict[int, int] = {}
        open_bands: dict[int, list[tuple[int, int]]] = {}  # by edits, which give the width: item and first diagonal
        for k, found in zip(which[good].tolist(), keys[good].tolist()):
            if k not in exact:
                exact[k] = text.find(self.texts[k])
                if exact[k] >= 0:
                    best[k] = (0, exact[k], exact[k] + len(self.texts[k]))
            if exact[k] < 0:
                e = int(self.edits[k])
                open_bands.setdefault(e, []).append((k, ((found & 0xFFFFFFFF) - shift) * (e + 1)))
        for e, bands in open_bands.items():
            per = max(1, ALIGNED // (2 * e + 2))
            for first in range(0, len(bands), per):
                part = bands[first : first + per]
                lows = np.array([low for _, low in part])
                begin = max(0, int(lows.min()) - 1)  # the part of the text that these diagonals reach
                end = int(lows.max()) + 2 * e + 2 + max(len(self.codes[k]) for k, _ in part)
                found = aligned_many([self.codes[k] for k, _ in part], codes[begin : max(begin, end)], lows - begin, 2 * e + 2)
                for (k, _), edits, start, stop in zip(part, *(f.tolist() for f in found)):
                    if edits <= e and (k not in best or (edits, start + begin) < best[k][:2]):
                        best[k] = (edits, start + begin, stop + begin)
        for k in sorted(best):
            yield k, *best[k]


def _blocks(benchmark: DataFrame, rate: float) -> Iterator[Items]:
    """The benchmark in blocks of about ``BLOCK_CHARS`` characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        yield Items([(r.item_id, r.text) for r in part.collect()], rate)


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The normalised texts of a column in groups of about ``CHUNK`` characters, with their first rows."""
    group, size, first = [], 0, 0
    for row in range(len(column)):
        text = normalised(column[row].as_py())
        group.append(text)
        size += len(text)
        if size >= CHUNK:
            yield first, group
            group, size, first = [], 0, row + 1
    if group:
        yield first, group


_FOUND = "doc_id long, item_id long, edits long, start_char long, end_char long"


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, edits, start_char, end_char.

    Places are code points of the text in lower case with single spaces, end exclusive; of several places the one
    with fewest edits, then the first. Null and empty texts hold nothing; null or blank items and items without an id are
    left out; an item shorter than a q-gram must occur exactly, as whole words. Repeated rows are answered once each; other columns of
    either table are ignored. An empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    out = None
    for items in _blocks(benchmark, rate):
        shared = spark.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column(0), []
                for first, texts in _groups(batch.column(1)):
                    found += [(ids[first + row].as_py(), *rest) for row, *rest in shared.value.matches(texts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[k] for f in found], type=pa.int64()) for k in range(5)],
                    names=["doc_id", "item_id", "edits", "start_char", "end_char"],
                )

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, _FOUND)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _FOUND) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item is found; all columns stay."""
    spark = docs.sparkSession
    for items in _blocks(benchmark, rate):
        shared = spark.sparkContext.broadcast(items)
        place = docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for first, texts in _groups(batch.column(place)):
                    for row, *_ in shared.value.matches(texts):
                        clean[first + row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, T.StructType(docs.schema.fields))
    return docs

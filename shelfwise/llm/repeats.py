"""Periodic runs of words, found by block convolution.

Words are numbered so that no two texts share a number; a batch of texts is then one sequence. At every dyadic scale L it
is cut into blocks of L words. Exact number-theoretic transforms give the sums of squared differences between a block
and all places of the window that follows it at distances 2L to 4L-1 (1 to 7 at the smallest scale): a sum of zero is an
occurrence, and its distance a period to extend. A run with period q of at least max(12, 2q) words holds such a
block for the scale of q, so no run is missed. Blocks with a word that does not come back within the window can have no
occurrence and are left out of the transforms.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.textnp import pieces

#: A run has at least this many words, and twice its period.
SHORTEST = 12
#: A prime with roots of unity of order 2**23, and a generator of its units.
PRIME, GENERATOR = 998244353, 3
#: Points transformed at once.
POINTS = 1 << 20

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a repeated tail in a tenth of the documents, chosen by a checksum of the id; a null id gets none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    unit = words[start : start + period]
    return words[:start] + (unit * ((n - start) // period + 1))[: n - start]


# --- number-theoretic transforms ----------------------------------------------------

_roots: dict[tuple[int, bool], list[np.ndarray]] = {}


def _twiddles(size: int, inverse: bool) -> list[np.ndarray]:
    """The powers of the roots of unity of each level."""
    if (size, inverse) not in _roots:
        levels, half = [], 1
        while half < size:
            root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
            root = pow(root, -1, PRIME) if inverse else root
            powers = np.ones(half, dtype=np.uint64)
            step, filled = root, 1
            while filled < half:  # doubling: the known powers times the next one
                powers[filled : 2 * filled] = powers[:filled] * np.uint64(step) % np.uint64(PRIME)
                step, filled = step * step % PRIME, 2 * filled
            levels.append(powers)
            half *= 2
        _roots[size, inverse] = levels
    return _roots[size, inverse]


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The transforms of the rows of a matrix, whose length is a power of two, modulo ``PRIME``."""
    count, size = rows.shape
    prime = np.uint64(PRIME)
    x = rows.reshape(count, 1, size)
    for powers in _twiddles(size, inverse):  # the Stockham form: no reordering by reversed bits
        half = len(powers)
        rest = x.shape[2] // 2
        even, odd = x[:, :, :rest], x[:, :, rest:]
        odd = odd * powers[None, :, None] % prime
        x = np.concatenate([(even + odd) % prime, (even + prime - odd) % prime], axis=1)
        assert x.shape[1] == 2 * half
    x = x.reshape(count, size)
    if inverse:
        x = x * np.uint64(pow(size, -1, PRIME)) % prime
    return x


def differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences between each row of ``blocks`` and every place of its row of ``windows``.

    Exact while a block's length times the square of the largest value stays under ``PRIME``.
    """
    length, span = blocks.shape[1], windows.shape[1]
    size = 1 << (span - 1).bit_length()
    prime = np.uint64(PRIME)
    a = np.zeros((len(blocks), size), dtype=np.uint64)
    a[:, :length] = blocks[:, ::-1]
    b = np.zeros((len(blocks), size), dtype=np.uint64)
    b[:, :span] = windows
    product = transform(transform(a) * transform(b) % prime, inverse=True)[:, length - 1 : span]
    squares = np.zeros((len(blocks), span + 1), dtype=np.uint64)
    np.cumsum(windows * windows, axis=1, out=squares[:, 1:])
    window = squares[:, length:] - squares[:, : span + 1 - length]
    own = (blocks * blocks).sum(axis=1, dtype=np.uint64)
    return (own[:, None] + window + (prime - product) * np.uint64(2)) % prime


# --- runs ------------------------------------------------------------------------------

def _scatter(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits for symbols: equal symbols get equal values."""
    mixed = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def _coming_back(symbols: np.ndarray) -> np.ndarray:
    """How many places further each symbol comes again (more than all places if it does not)."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    gaps = np.full(n, 2 * n + 8, dtype=np.int64)
    same = symbols[order[1:]] == symbols[order[:-1]]
    gaps[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gaps


def _seeds(symbols: np.ndarray, back: np.ndarray, length: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of blocks of ``length`` symbols and distances from ``low`` to ``high`` at which they occur again."""
    n = len(symbols)
    count = n // length
    far = back[: count * length].reshape(count, length).max(axis=1)
    starts = np.flatnonzero(far <= high) * length
    span = high - low + length
    bits = min(20, (29 - (length - 1).bit_length()) // 2)
    values = np.zeros(n + high + length, dtype=np.uint64)
    values[:n] = _scatter(symbols, bits)
    per = max(1, POINTS // (1 << (span - 1).bit_length()))
    for first in range(0, len(starts), per):
        at = starts[first : first + per]
        blocks = values[at[:, None] + np.arange(length)]
        windows = values[at[:, None] + np.arange(low, low + span)]
        row, lag = np.nonzero(differences(blocks, windows) == 0)
        place, distance = at[row], lag + low
        inside = place + distance + length <= n
        place, distance = place[inside], distance[inside]
        if len(place):
            yield place, distance


def _agreement(symbols: np.ndarray, i: int, j: int, step: int) -> int:
    """How many symbols from ``i`` and ``j`` on agree, forwards (step 1) or backwards (step -1); ``i`` < ``j``."""
    n, done, chunk = len(symbols), 0, 16
    while True:
        if step > 0:
            width = min(chunk, n - j - done)
            a, b = symbols[i + done : i + done + width], symbols[j + done : j + done + width]
        else:
            width = min(chunk, i + 1 - done)
            a, b = symbols[i - done - width + 1 : i - done + 1][::-1], symbols[j - done - width + 1 : j - done + 1][::-1]
        if width <= 0:
            return done
        differ = np.flatnonzero(a != b)
        if len(differ):
            return done + int(differ[0])
        done, chunk = done + width, chunk * 2


class _Known:
    """The runs found so far, to leave out seeds that say nothing new."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int]] = []  # start, end, period
        self.made = 0

    def _arrays(self) -> None:
        if self.made < len(self.runs):
            rows = np.array(sorted(self.runs), dtype=np.int64)
            self.start, self.end, self.period = rows[:, 0], rows[:, 1], rows[:, 2]
            self.made = len(self.runs)

    def covered(self, places: np.ndarray, distance: int, length: int) -> np.ndarray:
        """Which seeds lie with their occurrence inside a run whose period divides the distance."""
        if not self.runs:
            return np.zeros(len(places), dtype=bool)
        self._arrays()
        fit = distance % self.period == 0
        start = self.start[fit]
        if not len(start):
            return np.zeros(len(places), dtype=bool)
        reach = np.append(-1, np.maximum.accumulate(self.end[fit]))
        return reach[np.searchsorted(start, places, side="right")] >= places + distance + length


def runs_of(symbols: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Rows (start, length, period) of all runs, sorted: stretches of at least max(``SHORTEST``, 2 * period) symbols with
    that smallest period which no neighbouring symbol extends. ``longest`` bounds the length of a run if it is known."""
    n = len(symbols)
    longest = n if longest is None else min(n, longest)
    if longest < SHORTEST:
        return np.zeros((0, 3), dtype=np.int64)
    back, known, found = _coming_back(symbols), _Known(), []
    length = 2
    while length == 2 or 4 * length <= longest:
        low, high = (1, 7) if length == 2 else (2 * length, 4 * length - 1)
        for places, distances in _seeds(symbols, back, length, low, high):
            order = np.lexsort((places, distances))
            places, distances = places[order], distances[order]
            cuts = np.flatnonzero(np.diff(distances)) + 1
            for group in np.split(np.arange(len(places)), cuts):
                q, at = int(distances[group[0]]), places[group]
                at = at[~known.covered(at, q, length)]
                done = -1
                for i in at.tolist():
                    if i < done:
                        continue  # inside the stretch just found
                    ahead = _agreement(symbols, i, i + q, 1)
                    done = i + ahead
                    start = i - _agreement(symbols, i - 1, i + q - 1, -1) if i else 0
                    end = done + q
                    if ahead < length or end - start < max(SHORTEST, 2 * q):
                        continue
                    known.runs.append((start, end, q))
                    found.append((start, end - start, q))
        length *= 2
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    rows = np.unique(np.array(found, dtype=np.int64), axis=0)
    first = np.append(True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1))  # of one stretch the smallest period
    return rows[first]


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """One sequence of numbers for the words of several texts; no two texts share a number."""
    out = np.empty(sum(map(len, texts)), dtype=np.int64)
    at = base = 0
    for words in texts:
        seen: dict[bytes, int] = {}
        out[at : at + len(words)] = [seen.setdefault(w, base + len(seen)) for w in words]
        at, base = at + len(words), base + len(seen)
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by a space."""
    if not len(runs):
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(steps)[:-1] == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, runs (array of start, length, period, sorted), collapsed.

    Words are runs of anything but ASCII white space; starts are word numbers. ``rewrite`` may change a row's words first.
    ``collapsed`` holds the words outside repetitions, joined by one space. A null or empty text has no runs and an empty
    ``collapsed``. Repeated rows, null ids and other columns need no care; a text is worked on whole, alone if it is long.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            ids = batch.column(0)
            texts = [(t.as_py() or "").encode().split() for t in batch.column(1)]
            if rewrite:
                texts = [rewrite(d, w) for d, w in zip(ids.to_pylist(), texts)]
            ends = np.cumsum([0, *map(len, texts)])
            rows = runs_of(numbered(texts), max(map(len, texts), default=0))
            cuts = np.searchsorted(rows[:, 0], ends)
            short = []
            for k, words in enumerate(texts):
                own = rows[cuts[k] : cuts[k + 1]] - [[ends[k], 0, 0]]
                short.append(collapsed(words, own))
                rows[cuts[k] : cuts[k + 1], 0] = own[:, 0]
            listed = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(run))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), listed), pa.array([s.decode() for s in short], type=pa.string())],
                names=["doc_id", "runs", "collapsed"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        find, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of the runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.s").alias("start"),
        (-F.col("_best.l")).alias("length"),
        F.col("_best.p").alias("period"),
        F.floor(-1000 * F.col("_best.l") / F.col("_best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""How the tokens of two tokenizers line up, with every distinct text worked on once.

Texts are shuffled whole, and of equal ones a single row goes on with its number of documents. A text is tokenised by
both tokenizers; the byte offsets where a token of either ends at once cut it into groups, and the tokens of a group are
linked. A task works on blocks of texts: per block it hands on the id pairs once, with the number of documents that hold
them, and per text the pairs as places in the block's list. So the corpus-wide counts are summed over blocks and come
back to blocks, not to texts. What a text measures is then joined to the ids of its documents by a digest of the text.

Both tokenizers work on segments that begin with a space behind a visible character: neither has a token across such a
place (checked for the second one's vocabulary, given by the first one's pattern), so repeated segments are aligned once.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import bpe
from shelfwise.llm.storage import stored
from shelfwise.llm.textnp import gathered, pieces

#: Where the second tokenizer's file lies.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text in a block and of those worked on at once, and segments kept by a worker.
BLOCK, AT_ONCE, SEGMENTS = 4 << 20, 1 << 19, 1 << 18
#: A group with more links than this is counted by distinct ids.
LINKS = 4096
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_CUTS = re.compile(r"(?<=\S)(?= )")


class Pieces:
    """The second tokenizer: its ids of a text that begins with a space, and the bytes of its pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.tokens = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(MARK, " ").encode() for p in names]
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError(f"{path} has pieces across words: texts could not be cut into segments")
        self.space = self.model.piece_to_id(MARK)

    def encode(self, segments: list[str]) -> list[list[int]]:
        """The ids of segments, each of which begins with a space: the library adds that one itself."""
        found = self.model.encode([s[1:] for s in segments], num_threads=1)
        return [ids if len(s) > 1 else [self.space] for ids, s in zip(found, segments)]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[k]`` to ``starts[k] + sizes[k] - 1`` for all k, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Grown:
    """An array that grows by doubling."""

    def __init__(self) -> None:
        self.data, self.size = np.zeros(1024, dtype=np.int64), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(need, len(self.data)), dtype=np.int64)])
        self.data[self.size : need] = values
        self.size = need


class Words:
    """The first tokenizer: its ids of texts, special tokens' strings being plain text, and the bytes of its tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokens = bpe.vocabulary(path).tokens
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True

    def encode(self, segments: list[str]) -> list[list[int]]:
        """The ids of segments."""
        return [e.ids for e in self.model.encode_batch_fast(segments, add_special_tokens=False)]


class _Places(dict):
    """The places of segments; new ones wait in ``pending`` for the places from ``begin`` on."""

    begin = 0

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = found = self.begin + len(self.pending)
        self.pending.append(segment)
        return found


class Aligner:
    """Aligns segments, keeps what it found, and sums it up per text."""

    def __init__(self, first: str = bpe.VOCABULARY, second: str = PIECES) -> None:
        self.a, self.b = Words(first), Pieces(second)
        self.sizes_a = np.array([len(t) for t in self.a.tokens])
        self.sizes_b = np.array([len(t) for t in self.b.tokens])
        self.most = max(len(self.sizes_a), len(self.sizes_b))
        self.decimals = pa.array([f"{i}{c}" for c in (",", "|", ";", "") for i in range(self.most)], type=pa.large_binary())
        self.clear()

    def clear(self) -> None:
        self.index = _Places()
        self.listed: list[bytes] = []  # a segment's groups as text
        self.sums = {k: _Grown() for k in ("good", "n_a", "n_b", "n_groups", "n_links", "pairs")}
        self.pairs, self.times = _Grown(), _Grown()
        self.codes: dict[int, int] = {}  # id pairs and their numbers
        self.code_list = _Grown()

    def groups(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """Of all segments, one after another: both sides' ids, the group of each token, the segment of each group, and
        which segments are good: those whose pieces give their bytes."""
        ids_a, ids_b = self.a.encode(segments), self.b.encode(segments)
        good = np.array([b"".join([self.b.tokens[i] for i in ids]) == s.encode() for ids, s in zip(ids_b, segments)], dtype=bool)
        flat = [np.fromiter((i for ids, ok in zip(lists, good) if ok for i in ids), dtype=np.int64) for lists in (ids_a, ids_b)]
        ends = [np.cumsum(sizes[ids]) for sizes, ids in zip((self.sizes_a, self.sizes_b), flat)]
        shared = ends[0][np.isin(ends[0], ends[1], assume_unique=True)]
        side = [np.searchsorted(shared, e) for e in ends]
        lengths = np.array([len(s.encode()) if ok else 0 for s, ok in zip(segments, good)])
        owner = np.searchsorted(np.cumsum(lengths), shared)  # segments without bytes end where the one before does
        return flat[0], flat[1], side[0], side[1], owner, good

    def align(self, segments: list[str]) -> None:
        """Work on new segments and add them to the tables, in their order."""
        a, b, group_a, group_b, owner, good = self.groups(segments)
        count, n = len(owner), len(segments)
        per_a, per_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
        self._list(a, b, group_a, group_b, per_a, per_b, owner, n)
        links = per_a * per_b
        sums = {k: np.bincount(owner, weights=v, minlength=n).astype(np.int64) for k, v in (("n_a", per_a), ("n_b", per_b), ("n_links", links))}
        sums |= {"n_groups": np.bincount(owner, minlength=n), "good": good.astype(np.int64)}
        begin_a, begin_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        few = links[group_a] <= LINKS
        times = per_b[group_a[few]]
        left = np.repeat(a[few], times)
        right = b[_ragged(begin_b[group_a[few]], times)]
        where = [np.repeat(owner[group_a[few]], times)]
        codes, weights = [(left << 32) | right], [np.ones(len(left), dtype=np.int64)]
        for g in np.flatnonzero(links > LINKS):
            one, ones = np.unique(a[begin_a[g] : begin_a[g] + per_a[g]], return_counts=True)
            other, others = np.unique(b[begin_b[g] : begin_b[g] + per_b[g]], return_counts=True)
            codes.append(((one << 32)[:, None] | other).ravel())
            weights.append((ones[:, None] * others).ravel())
            where.append(np.full(len(codes[-1]), owner[g]))
        known, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        keys, spots = np.unique(np.concatenate(where) * max(1, len(known)) + inverse, return_inverse=True)
        new = [self.codes.setdefault(c, len(self.codes)) for c in known.tolist()]
        self.code_list.add(known[np.array(new, dtype=np.int64) >= self.code_list.size])
        self.pairs.add(np.array(new, dtype=np.int64)[keys % max(1, len(known))])
        self.times.add(np.bincount(spots, weights=np.concatenate(weights), minlength=len(keys)).astype(np.int64))
        sums["pairs"] = np.bincount(keys // max(1, len(known)), minlength=n)
        for k, v in sums.items():
            self.sums[k].add(v)

    def _list(self, a, b, group_a, group_b, per_a, per_b, owner, n) -> None:
        """The groups of each segment as text: every id is looked up together with the sign that follows it."""
        count = len(owner)
        ends_a, ends_b = np.cumsum(per_a), np.cumsum(per_b)
        out = np.zeros(len(a) + len(b), dtype=np.int64)
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last_a[ends_a - 1] = last_b[ends_b - 1] = True
        closing = np.append(owner[1:] != owner[:-1], True) if count else np.zeros(0, dtype=bool)
        out[np.arange(len(a)) + (ends_b - per_b)[group_a]] = a + self.most * last_a
        out[np.arange(len(b)) + ends_a[group_b]] = b + self.most * np.where(last_b, 2 + closing[group_b], 0)
        data, offsets = gathered(self.decimals, out)
        tokens = np.append(0, np.cumsum(np.bincount(owner, weights=per_a + per_b, minlength=n).astype(np.int64)))
        cuts = offsets[tokens].tolist()
        self.listed += [bytes(data[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]

    def places(self, segments: list[list[str]]) -> np.ndarray:
        """The table places of the segments of several texts, one after another; new ones are aligned."""
        self.index.begin = len(self.listed)
        out = np.fromiter(map(self.index.__getitem__, chain.from_iterable(segments)), dtype=np.int64)
        if self.index.pending:
            self.align(self.index.pending)
            self.index.pending = []
        return out

    def texts(self, texts: list[str]) -> dict[str, list]:
        """Per text its sums, the digest of its groups, and its distinct pairs (numbers, sorted) with their links."""
        segments = [_CUTS.split(" " + t) if t else [] for t in texts]
        where = self.places(segments)
        counts = np.array([len(s) for s in segments])
        stops = np.append(0, np.cumsum(counts))
        owner = np.repeat(np.arange(len(texts)), counts)
        good = np.bincount(owner, weights=1 - self.sums["good"].data[where], minlength=len(texts)) == 0
        good &= counts > 0
        out: dict[str, list] = {
            k: np.where(good, np.bincount(owner, weights=self.sums[k].data[where], minlength=len(texts)), 0).astype(np.int64)
            for k in MEASURES[:4]
        }
        get = self.listed.__getitem__
        out["digest"] = [
            hashlib.sha256(b";".join(map(get, where[x:y].tolist()))).hexdigest() if ok else ""
            for x, y, ok in zip(stops[:-1], stops[1:], good)
        ]
        used = good[owner]
        where, owner = where[used], owner[used]
        sizes = self.sums["pairs"].data
        begins = np.append(0, np.cumsum(sizes[: self.sums["pairs"].size]))
        places = _ragged(begins[where], sizes[where])
        width = max(1, self.code_list.size)
        keys = np.repeat(owner, sizes[where]) * width + self.pairs.data[places]
        order = np.argsort(keys)
        keys, times = keys[order], self.times.data[places[order]]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        out["times"] = np.add.reduceat(times, heads) if len(heads) else times
        keys = keys[heads]
        out["pairs"] = keys % width
        out["pair_counts"] = np.bincount(keys // width, minlength=len(texts))
        return out


_aligners: dict[tuple, Aligner] = {}


def aligner(first: str = bpe.VOCABULARY, second: str = PIECES) -> Aligner:
    """An aligner, made once in each Python worker."""
    if (first, second) not in _aligners:
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


def aligned(text: str, first: str = bpe.VOCABULARY, second: str = PIECES) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: the ids of either side. Empty where the pieces don't give the bytes of the text."""
    tool = aligner(first, second)
    a, b, group_a, group_b, owner, good = tool.groups(_CUTS.split(" " + text)) if text else [np.zeros(0, dtype=np.int64)] * 6
    if not len(owner) or not good.all():
        return []
    return [(a[group_a == g].tolist(), b[group_b == g].tolist()) for g in range(len(owner))]


# --- the job ------------------------------------------------------------------------------

_BLOCK_SCHEMA = (
    "block long, keys array<binary>, digests array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, pair_counts array<int>, steps array<int>, times array<int>, codes array<long>, documents array<long>"
)


def linked_blocks(texts: DataFrame, first: str = bpe.VOCABULARY, second: str = PIECES, block: int = BLOCK) -> DataFrame:
    """Blocks of distinct texts (text, key, documents): per text its sums and digest and the links of its pairs, as steps
    between places in the block's list of pairs; per pair of the list its code and the documents that hold it."""
    kinds = [pa.list_(k) for k in (pa.binary(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())]
    names = [c.split()[0] for c in _BLOCK_SCHEMA.split(", ")]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(first, second)
        serial = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, serial
            join = lambda k: np.concatenate([h[2][k] for h in held])
            counts, pairs = join("pair_counts"), join("pairs")
            documents = np.repeat(np.concatenate([h[1] for h in held]), counts)
            numbers, slots = np.unique(pairs, return_inverse=True)
            totals = np.zeros(len(numbers), dtype=np.int64)
            np.add.at(totals, slots, documents)
            steps = np.diff(slots, prepend=0)
            steps[(np.cumsum(counts) - counts)[counts > 0]] = slots[(np.cumsum(counts) - counts)[counts > 0]]
            columns = [
                np.concatenate([h[0] for h in held]), [d for h in held for d in h[2]["digest"]], *(join(k) for k in MEASURES[:4]),
                counts, steps, join("times"), tool.code_list.data[numbers], totals,
            ]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], type=pa.int32()), pa.array(c, type=k.value_type)) for c, k in zip(columns, kinds)]
            out = pa.RecordBatch.from_arrays([pa.array([serial]), *lists], names=names)
            held, size, serial = [], 0, serial + 1
            if len(tool.listed) > SEGMENTS:
                tool.clear()
            return out

        for batch in pieces(batches, 0, AT_ONCE):
            if not batch.num_rows:
                continue
            texts = batch.column(0).to_pylist()
            held.append((np.array(batch.column(1).to_pylist(), dtype=object), batch.column(2).to_numpy(), tool.texts(texts)))
            size += batch.column(0).nbytes
            if size >= block:
                yield flush()
        if held:
            yield flush()

    return texts.select("text", "key", "documents").mapInArrow(link, _BLOCK_SCHEMA)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """code, first_id, second_id, documents, best: in how many documents an id pair is linked, and whether no other pair
    of its first id is in more. A first id has at most as many pairs as the second tokenizer has ids."""
    pairs = blocks.select(F.explode(F.arrays_zip("codes", "documents")).alias("p")).select(F.col("p.codes").alias("code"), F.col("p.documents").alias("n"))
    counts = pairs.groupBy("code").agg(F.sum("n").alias("documents")).withColumn("first_id", F.shiftright("code", 32).cast("int"))
    highest = F.max("documents").over(Window.partitionBy("first_id"))
    second = F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return counts.select("code", "first_id", second.alias("second_id"), "documents", (F.col("documents") == highest).alias("best"))


def _evaluated(blocks: DataFrame) -> DataFrame:
    """Per text of blocks with ``found`` (place, documents, best): its key and measures."""
    names = ["key", *MEASURES, "groups_sha256"]

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].values for k, n in enumerate(batch.schema.names) if n != "block"}
                steps, times = row["steps"].to_numpy(), row["times"].to_numpy().astype(np.int64)
                found = row["found"]
                place = found.field("place").to_numpy()
                size = int(place.max()) + 1 if len(place) else 0
                documents, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
                documents[place] = found.field("documents").to_numpy()
                best[place] = found.field("best").to_numpy(zero_copy_only=False)
                counts = row["pair_counts"].to_numpy()
                ends = np.cumsum(counts)
                total = np.cumsum(steps)  # over all texts; each text begins anew
                before = np.append(0, total)[ends - counts]
                slots = total - np.repeat(before, counts)
                sums = [np.append(0, np.cumsum(times * v[slots])) for v in (best, documents)]
                sums = [pa.array(s[ends] - s[ends - counts]) for s in sums]
                yield pa.RecordBatch.from_arrays(
                    [row["keys"], *(row[k] for k in MEASURES[:4]), *sums, row["digests"]], names=names
                )

    listed = ", ".join(f"{m} long" for m in MEASURES)
    return blocks.mapInArrow(evaluate, f"key binary, {listed}, groups_sha256 string")


def text_key(text: Column) -> Column:
    """The digest that stands for a text."""
    return F.unhex(F.sha2(text, 256))


def measured(docs: DataFrame, first: str = bpe.VOCABULARY, second: str = PIECES, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text without tokens (null, empty, or one whose pieces give other bytes) has zeros and an empty digest. Every row
    counts as a document, repeated rows too; null ids and other columns need no care. Rows without a text get keys of
    their own, so that they meet in no task; those of a very frequent text are split by the join.
    """
    rows = docs.select("doc_id", "text")
    has = F.col("text").isNotNull() & (F.col("text") != "")
    texts = rows.where(has).groupBy("text").agg(F.count("*").alias("documents")).withColumn("key", text_key(F.col("text")))
    blocks = stored(linked_blocks(texts, first, second, block))
    listed = blocks.select("block", F.posexplode("codes").alias("place", "code"))
    found = listed.join(pair_counts(blocks).select("code", "documents", "best"), "code")
    back = found.groupBy("block").agg(F.collect_list(F.struct("place", "documents", "best")).alias("found"))
    measures = _evaluated(blocks.drop("codes", "documents").join(back, "block", "left").withColumn("found", F.coalesce("found", F.array())))
    own = F.unhex(F.md5(F.concat_ws(":", F.lit("none"), F.col("doc_id"))))
    keyed = rows.select("doc_id", F.when(has, text_key(F.col("text"))).otherwise(own).alias("key"))
    joined = keyed.join(measures, "key", "left")
    return joined.select(
        "doc_id", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )

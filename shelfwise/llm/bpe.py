"""Byte-level BPE encoding by tree concatenation, and decoding.

A text is cut into words by the tokenizer's pattern and each word's bytes are merged. Long unsplit words are a tree: both
halves are encoded, then a window around their join is encoded anew and grows until its outer tokens are those of the
halves. Adjacent tokens that are the encoding of their own bytes make a whole that is, so the result is exact. Texts over
``LONG`` bytes are cut into rows first: other tasks encode the parts, one task per text joins them.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfwise.llm.textnp import gathered, pieces

#: Where the vocabulary file lies.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of a leaf of the tree, and tokens on either side of a join that are encoded anew at first.
LEAF, WINDOW = 256, 4
#: Texts of more bytes are shared among tasks, in parts of about ``PART`` bytes.
LONG, PART = 1 << 20, 1 << 16
#: Segments kept with their ids by a Python worker (twice as many at most), and the longest of them.
MEMO, MEMO_CHARS = 1 << 18, 48

# Fixed value: how the byte-level pre-tokenizer splits text.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Words never go on over these places, and what stands on one side does not change how the other is split.
_CUTS = re.compile(r"(?<=\S)(?= )")
_FAR = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, token bytes and special tokens of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            raw = json.load(file)
        shape = raw["pre_tokenizer"] or {}
        if raw["model"]["type"] != "BPE" or shape.get("type") != "ByteLevel" or shape.get("add_prefix_space") or raw["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        alphabet, ids = byte_alphabet(), raw["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.tokens: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, at in ids.items():
            self.tokens[at] = bytes(alphabet[c] for c in token)
        for token, at in self.special.items():
            self.tokens[at] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in raw["model"]["merges"]]
        self.size = len(self.tokens)
        self.rank = {ids[a] * self.size + ids[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.byte_ids = [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        if len({*self.made}) < len(self.made):
            raise ValueError(f"{path} makes one token by several merges: windows could not be joined")
        self.table = pa.array(self.tokens, type=pa.large_binary())


class Encoder:
    """Encodes texts; keeps the ids of short segments."""

    def __init__(self, vocabulary: Vocabulary, special: bool = True, leaf: int = LEAF) -> None:
        self.vocabulary, self.leaf = vocabulary, max(2, leaf)
        known = sorted(vocabulary.special, key=len, reverse=True) if special else []
        self.special = re.compile("(" + "|".join(map(re.escape, known)) + ")") if known else None
        self.memo = _Memo(self)

    def merged(self, raw: bytes) -> list[int]:
        """The ids of a word: the merge of lowest rank first, the leftmost of equals."""
        if len(raw) > 2 * self.leaf:
            return self._merged_long(raw)
        v = self.vocabulary
        rank, made, size = v.rank.get, v.made, v.size
        ids = [v.byte_ids[b] for b in raw]
        ranks = [rank(a * size + b, _FAR) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _FAR:
                break
            at = ranks.index(least)
            new = ids[at] = made[least]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] * size + new, _FAR)
            if at < len(ranks):
                ranks[at] = rank(new * size + ids[at + 1], _FAR)
        return ids

    def _merged_long(self, raw: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        v = self.vocabulary
        rank, made, size = v.rank.get, v.made, v.size
        ids = [v.byte_ids[b] for b in raw]
        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] * size + ids[j]) != r:
                continue
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank(ids[h] * size + ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded parts together."""
        tokens, width = self.vocabulary.tokens, WINDOW
        while left and right:
            a, b = left[-width:], right[:width]
            ids = self.merged(b"".join([tokens[t] for t in a + b]))
            if (len(a) == len(left) or ids[0] == a[0]) and (len(b) == len(right) or ids[-1] == b[-1]):
                return left[: len(left) - len(a)] + ids + right[len(b) :]
            width *= 2
        return left or right

    def word(self, raw: bytes) -> list[int]:
        """The ids of one word of any length, as a tree over leaves."""
        if len(raw) <= self.leaf:
            return self.merged(raw)
        half = self.leaf  # a leaf times a power of two, so that repeated text falls alike into both sides
        while 2 * half < len(raw):
            half *= 2
        return self.joined(self.word(raw[:half]), self.word(raw[half:]))

    def segment(self, text: str) -> list[int]:
        """The ids of a text without special tokens."""
        if text.removeprefix(" ").isalpha():  # a run of letters is one word
            return self.word(text.encode())
        words = WORDS.findall(text)
        return [x for w in words for x in self.word(w.encode())]

    def text(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        self.memo.age()
        known = self.memo.__getitem__
        if self.special is None or not self.special.search(text):
            return np.frombuffer(b"".join(map(known, _CUTS.split(text))), dtype=np.int32)
        parts = []
        for i, part in enumerate(self.special.split(text)):  # every second one is a special token
            parts += [_packed([self.vocabulary.special[part]])] if i % 2 else map(known, _CUTS.split(part))
        return np.frombuffer(b"".join(parts), dtype=np.int32)


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class _Memo(dict):
    """Segments and their packed ids: those used since the last turn, and behind them those of the turn before."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = _packed(self.encoder.segment(text))
        if len(text) <= MEMO_CHARS:
            self[text] = found
        return found

    def age(self) -> None:
        """Forget what was not used for a whole turn."""
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()


_vocabularies: dict[str, Vocabulary] = {}
_encoders: dict[tuple, Encoder] = {}


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """A vocabulary, read once in each Python worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encoder(path: str = VOCABULARY, special: bool = True) -> Encoder:
    """An encoder, made once in each Python worker."""
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(vocabulary(path), special)
    return _encoders[path, special]


def id_lists(found: list[np.ndarray]) -> pa.Array:
    """A list column of id arrays."""
    ends = np.zeros(len(found) + 1, dtype=np.int32)
    np.cumsum([len(f) for f in found], out=ends[1:])
    flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))


def parts_of(text: str, special: re.Pattern | None, part: int = PART) -> Iterator[tuple[int, bytes]]:
    """(kind, bytes) of a long text's parts in their order: 0 is a text of its own, 1 a special token, 2 the begin of an
    unsplit word and 3 a further block of it. Special tokens of the text are whole; parts have about ``part`` bytes."""
    for i, run in enumerate(special.split(text) if special else [text]):
        if i % 2:
            yield 1, run.encode()
            continue
        whole: list[str] = []
        size = 0
        for segment in _CUTS.split(run):
            if len(segment) > part:
                if whole:
                    yield 0, "".join(whole).encode()
                    whole, size = [], 0
                for word in WORDS.findall(segment):
                    raw = word.encode()
                    for at in range(0, len(raw), part):
                        yield 2 + (at > 0), raw[at : at + part]
                continue
            whole.append(segment)
            size += len(segment)
            if size >= part:
                yield 0, "".join(whole).encode()
                whole, size = [], 0
        if whole:
            yield 0, "".join(whole).encode()


def encoded(
    docs: DataFrame, path: str = VOCABULARY, special: bool = True, long_bytes: int = LONG, part: int = PART, again: bool = False
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ids (array of int); with ``again`` also decoded, their text.

    The ids are those of the tokenizers library without added tokens; with ``special`` the strings of special tokens in a
    text are those tokens. A null or empty text has no ids. Repeated rows, null ids and other columns need no care. Each
    worker reads ``path``. A text over ``long_bytes`` goes to other tasks in parts of ``part`` bytes and is put together in one.
    """
    rows = docs.select("doc_id", "text")
    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))

    def finished(doc_ids: pa.Array, ids: pa.Array) -> pa.RecordBatch:
        texts = [texts_of(vocabulary(path), ids)] if again else []
        return pa.RecordBatch.from_arrays([doc_ids, ids, *texts], names=["doc_id", "ids", "decoded"][: 2 + len(texts)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, special)
        for batch in pieces(batches, 1):
            ids = id_lists([tool.text(t.as_py() or "") for t in batch.column(1)])
            yield finished(batch.column(0), ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, special)
        names = ["row", "doc_id", "at", "kind", "raw"]
        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = list(parts_of(text, tool.special, part))
                columns = [[row] * len(found), [doc] * len(found), [*range(len(found))], *map(list, zip(*found))]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, special)
        for batch in pieces(batches, 4):
            found = []
            for kind, raw in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if kind == 0:
                    found.append(tool.text(raw.decode()))
                elif kind == 1:
                    found.append(np.array([tool.vocabulary.special[raw.decode()]], dtype=np.int32))
                else:
                    found.append(np.array(tool.word(raw), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], id_lists(found)], names=["row", "doc_id", "at", "kind", "ids"])

    def together(table: pa.Table) -> pa.Table:
        tool = encoder(path, special)
        table = table.sort_by("at")
        done: list[np.ndarray] = []
        blocks: list[list[int]] = []

        def close() -> None:
            level = list(blocks)  # halves of halves, level by level
            while len(level) > 1:
                level = [tool.joined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            done.extend(np.array(x, dtype=np.int32) for x in level)
            blocks.clear()

        for kind, ids in zip(table.column("kind").to_pylist(), table.column("ids")):
            if kind != 3:
                close()
            if kind >= 2:
                blocks.append(ids.as_py())
            else:
                done.append(ids.values.to_numpy())
        close()
        doc_id = table.column("doc_id").slice(0, 1).combine_chunks()
        return pa.Table.from_batches([finished(doc_id, id_lists([np.concatenate(done)]))])

    split = rows.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = split.mapInArrow(cut, "row long, doc_id long, at long, kind int, raw binary")
    shared = parts.repartition("row", "at").mapInArrow(encode_part, "row long, doc_id long, at long, kind int, ids array<int>")
    schema = "doc_id long, ids array<int>" + ", decoded string" * again
    long_rows = shared.groupBy("row").applyInArrow(together, schema)
    return rows.where(~is_long).mapInArrow(whole, schema).unionByName(long_rows)


def texts_of(known: Vocabulary, column: pa.Array) -> pa.Array:
    """The texts of id lists."""
    values = column.flatten().to_numpy(zero_copy_only=False)  # without what null rows hide
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    places = np.nan_to_num(values, nan=-1).astype(np.int64)
    inside = (places >= 0) & (places < known.size)
    data, offsets = gathered(known.table, places[inside])
    stops = offsets[np.append(0, np.cumsum(inside))[np.append(0, np.cumsum(sizes))]].tolist()
    rows = zip(stops[:-1], stops[1:], column.is_valid().to_pylist())
    return pa.array([str(data[a:b], "utf-8", "replace") if ok else None for a, b, ok in rows], type=pa.string())


def decoded(df: DataFrame, path: str = VOCABULARY, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the column ``text``: the text of the tokens in ``ids``, special tokens included.

    Bytes that are no UTF-8 become the replacement character; ids outside the vocabulary are skipped, as the library does.
    Null ids give a null text.
    """
    if text in df.columns:
        raise ValueError(f"{text} is a column already: name another")
    at = df.columns.index(ids)
    schema = StructType([*df.schema.fields, StructField(text, StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, texts_of(vocabulary(path), batch.column(at))], names=schema.names)

    return df.mapInArrow(decode, schema)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )

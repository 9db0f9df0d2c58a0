"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton lists the vocabulary entries that end at each character; dynamic programming carries the best
score and its number of pieces. Ties go to the entry that starts first, as in the tokenizers' own lattice, and so does
the order of additions. Characters that no single entry covers are unknown: a run of them is one piece, or with byte
fall-back one piece per UTF-8 byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary file lies.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: What stands for the space before a word.
MARK = "▁"
#: An unknown character scores this much less than the worst entry.
UNKNOWN = 10.0
#: Words kept with their counts by a Python worker, and the longest of them.
MEMO_WORDS, MEMO_CHARS = 1 << 20, 48
#: White space between words (Unicode's White_Space).
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """The entries and scores of a sentencepiece file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@dataclass
class Counter:
    """Counts the pieces of words."""

    entries: list[tuple[str, float]]
    byte_fallback: bool = True
    memo: dict[str, tuple[int, int]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.entries:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in self.entries), default=0.0) - UNKNOWN
        pieces = {p for p, _ in self.entries}
        self.single = frozenset(p for p in pieces if len(p) == 1)
        self.bytes = self.byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))

    def count(self, text: str) -> tuple[int, int]:
        """(pieces, unknown characters) of the best segmentation of ``text``.

        The automaton lists entries by their ends and, of one end, the longest first: the earliest start is seen first
        and only a higher score replaces it. Where every character is an entry, nothing can be unknown."""
        n = len(text)
        if self.single.issuperset(text):
            best, pieces = [float("-inf")] * (n + 1), [0] * (n + 1)
            best[0] = 0.0
            for end, (size, value) in self.automaton.iter(text):
                new = value + best[end + 1 - size]
                if new > best[end + 1]:
                    best[end + 1], pieces[end + 1] = new, pieces[end + 1 - size] + 1
            return pieces[n], 0
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, entry in self.automaton.iter(text):
            ending[end].append(entry)
        score, pieces, unknown, run = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best, known = None, False
            for size, value in ending[end - 1]:
                start = end - size
                new = value + score[start]
                known = known or size == 1
                if best is None or new > best:
                    best, piece, lost, tail = new, pieces[start] + 1, unknown[start], False
            if not known:
                start = end - 1
                new = self.unknown + score[start]
                if best is None or new > best:
                    cost = len(text[start].encode("utf-8", "surrogatepass")) if self.bytes else int(not run[start])
                    best, piece, lost, tail = new, pieces[start] + cost, unknown[start] + 1, True
            score[end], pieces[end], unknown[end], run[end] = best, piece, lost, tail
        return pieces[n], unknown[n]

    def words(self, text: str) -> tuple[int, int]:
        """(pieces, unknown characters) of all words of ``text``, each behind the mark of a space (one that begins with it gets no second)."""
        total = lost = 0
        memo = self.memo
        for word in _SPACE.split(text):
            if not word:
                continue
            found = memo.get(word)
            if found is None:
                found = self.count(word if word[0] == MARK else MARK + word)
                if len(word) <= MEMO_CHARS:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = found
            total += found[0]
            lost += found[1]
        return total, lost


_counters: dict[str, Counter] = {}


def counter(path: str = MODEL) -> Counter:
    """The counter of a vocabulary file, made once in each Python worker."""
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def counted(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_unknown (characters that no entry covers).

    A null, empty or blank text has no tokens. Texts are cut at white space, so a document of any length needs memory
    for its longest word only. Repeated rows, null ids and other columns need no care. Each worker reads ``path``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = counter(path)
        for batch in batches:
            found = [tally.words(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[k] for f in found], type=pa.int64()) for k in (0, 1))],
                names=["doc_id", "n_tokens", "n_unknown"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_tokens long, n_unknown long")

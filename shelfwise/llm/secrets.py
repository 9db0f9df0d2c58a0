"""Secret scanning: a keyword automaton finds places, anchored patterns run only there, checksums confirm.

Kinds and what they must be:

- ``assign``: a keyword, ``=`` or ``:``, and a value of at least 6 characters;
- ``access``: ``AKIA`` and at least 16 more capitals or digits;
- ``hex``: at least 24 lower-case hexadecimal digits;
- ``github``, ``npm``: a prefix, 30 base-62 characters and their CRC-32 in 6 more;
- ``bip32``: an extended private key, base-58 with a double SHA-256 checksum.

Spans of one kind do not overlap; a candidate that fails its length consumes its characters, as in a left-to-right search.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in their order; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "bip32")
BASE = 3

_ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_BIP32 = re.compile(r"[xyzt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

#: Keywords in lower case and the kind whose pattern starts there.
_KEYWORDS = {
    "password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1,
    "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 4, "xprv": 5, "yprv": 5, "zprv": 5, "tprv": 5,
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


_AUTOMATON = _automaton()
_PATTERNS = {0: _ASSIGN, 1: _ACCESS, 3: _GITHUB, 4: _NPM, 5: _BIP32}
_LOWER = {c: c + 32 for c in range(65, 91)}


def crc_suffix(body: str) -> str:
    """The CRC-32 of ``body`` in six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _B62[digit] + out
    return out


def base58check(text: str) -> bool:
    """Whether the last four bytes are the double SHA-256 of those before."""
    value = 0
    for c in text:
        value = value * 58 + _B58.index(c)
    if value >> (82 * 8):
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _passes(kind: int, match: re.Match) -> bool:
    if kind == 0:
        return len(match[1]) >= 6
    if kind == 1:
        return len(match[0]) >= 20
    if kind == 5:
        return base58check(match[0])
    return crc_suffix(match[1][:-6]) == match[1][-6:]


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets, sorted; places are code points, ends exclusive."""
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    lower = text.lower()
    if len(lower) != len(text):
        lower = text.translate(_LOWER)
    done = [0] * len(KINDS)
    places = [(end + 1 - size, kind) for end, (size, kind) in _AUTOMATON.iter(lower)]
    places.sort()
    for start, kind in places:
        if start < done[kind]:
            continue
        match = _PATTERNS[kind].match(text, start)
        if match:
            ok = _passes(kind, match)
            if ok or kind < BASE:
                done[kind] = match.end()
            if ok:
                found.append((start, kind, match.end()))
    found.sort()
    return found


def joined(found: list[tuple[int, int, int]]) -> str:
    """``kind:start:end`` of the spans, comma-joined."""
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def scanned(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null or empty text has no spans. A row's result depends on its text alone; repeated rows, null ids and other
    columns need no care. ``base_sha256`` is the SHA-256 of the joined base spans, of the empty string if there are none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, listed = [], []
            for value in batch.column(1):
                found = spans(value.as_py() or "")
                base = [s for s in found if s[1] < BASE]
                for kind in range(BASE):
                    counts[kind].append(sum(s[1] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                listed.append(joined(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=pa.int64()) for c in counts), pa.array(digests, type=pa.string()), pa.array(listed, type=pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )

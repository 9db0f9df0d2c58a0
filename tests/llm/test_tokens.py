"""Token alignment, periodic runs and byte-level BPE against plain versions and the libraries themselves."""

import functools
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfwise.llm import bpe, repeats, token_links

ALPHABETS = [
    "ab", "a", " a", "a \n", "the ndion ", "0123456789", "=-_ ", "éñ ü字 ", "a\t 　b", "'st re", "a▁ ", "x\u0000 y", "ﬁ字漢 ", "<s>|",
    "<|endoftext|> a",
]
EDGES = [None, "", " ", "  ", "\n", "a ", " \n x", "▁", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext|", "'s", "a" * 3000, "ab" * 2000 + "c"]
SCHEMA = "doc_id long, text string, ids string, row long, block long, key string, code long, best int, found int, place int"


def texts_of(count, seed=5, long=600):
    pick = random.Random(seed)
    out = list(EDGES)
    for _ in range(count):
        alphabet = pick.choice(ALPHABETS)
        text = "".join(pick.choice(alphabet) for _ in range(pick.choice([1, 5, 30, long])))
        out.append(text + ("<|endoftext|>" + text[:9] if pick.random() < 0.2 else ""))
    return out


def frame(spark, texts, parts=3):
    rows = [(i, t, "x", 1, 2, "k", 3, 4, 5, 6) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


# --- byte-level BPE ---------------------------------------------------------------------

@functools.cache
def loaded():
    return Tokenizer.from_file(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return loaded()


def encode(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_the_library(spark, library):
    texts = texts_of(120) + [None, "a b"]
    rows = bpe.decoded(bpe.encoded(frame(spark, texts))).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = encode(library, texts[row.doc_id])
        assert row.ids == ids
        assert row.decoded == library.decode(ids, skip_special_tokens=False) == (texts[row.doc_id] or "")


def test_bpe_of_texts_shared_among_tasks(spark, library):
    texts = [t for t in texts_of(60, seed=6, long=2500) if t] + ["é" * 900 + " x" * 700, "<|endoftext|>" * 40]
    rows = bpe.encoded(frame(spark, texts), long_bytes=50, part=64, again=True).collect()
    assert {r.doc_id: r.decoded for r in rows} == dict(enumerate(texts))
    assert {r.doc_id: r.ids for r in rows} == {i: encode(library, t) for i, t in enumerate(texts)}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab =\né字", max_size=120) | st.text(max_size=60), st.integers(2, 9))
def test_tree_of_small_leaves(text, leaf):
    tool = bpe.Encoder(bpe.vocabulary(), leaf=leaf)
    assert tool.text(text).tolist() == encode(loaded(), text)


def test_join_is_exact_at_every_place(library):
    tool = bpe.Encoder(bpe.vocabulary(), leaf=8)
    for raw in (b"a" * 777, b"thetheethehe" * 40, bytes(range(97, 123)) * 30, b"=-" * 300 + b"=" * 61):
        whole = encode(library, raw.decode())
        for cut in range(1, len(raw), 7):
            assert tool.joined(tool.word(raw[:cut]), tool.word(raw[cut:])) == whole


def test_decoding_skips_unknown_ids_and_replaces_bad_bytes(spark, library):
    lists = [None, [], [50256, 64], [10**6, 65, -1], [160, 220]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    rows = {r.doc_id: r.decoded for r in bpe.decoded(df).collect()}
    assert rows[0] is None and rows[1] == ""
    assert rows[2] == library.decode(lists[2], skip_special_tokens=False)
    assert rows[3] == library.decode([65]) and rows[4] == library.decode(lists[4])


def test_bpe_digests_and_empty_tables(spark, library):
    row = bpe.digests(bpe.decoded(bpe.encoded(frame(spark, ["to be"])))).first()
    ids = encode(library, "to be")
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(b"to be").hexdigest()
    empty = bpe.digests(bpe.encoded(frame(spark, [None]), again=True)).first()
    assert (empty.n_tokens, empty.ids_sha256) == (0, hashlib.sha256(b"").hexdigest()) == (0, empty.decoded_sha256)
    assert bpe.encoded(frame(spark, ["x"]).limit(0)).count() == 0


# --- token alignment --------------------------------------------------------------------

class Plain:
    def __init__(self):
        self.first = Tokenizer.from_file(bpe.VOCABULARY)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=token_links.PIECES)
        names = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        is_byte = lambda p: len(p) == 6 and p.startswith("<0x")
        self.pieces = [bytes([int(p[3:5], 16)]) if is_byte(p) else p.replace("▁", " ").encode() for p in names]

    def groups(self, text):
        if not text:
            return []
        a, b = self.first.encode(" " + text, add_special_tokens=False).ids, self.second.encode(text)
        sizes = [[len(bpe.vocabulary().tokens[i]) for i in a], [len(self.pieces[i]) for i in b]]
        if b"".join(self.pieces[i] for i in b) != (" " + text).encode():
            return []
        ends = [np.cumsum(s).tolist() for s in sizes]
        out, i, j = [], 0, 0
        places = [{e: k + 1 for k, e in enumerate(side)} for side in ends]
        for end in sorted({*ends[0]} & {*ends[1]}):
            x, y = places[0][end], places[1][end]
            out.append((a[i:x], b[j:y]))
            i, j = x, y
        return out

    def measures(self, texts):
        groups = [self.groups(t) for t in texts]
        links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
        counts = Counter(pair for own in links for pair in own)
        highest = defaultdict(int)
        for (a, _), n in counts.items():
            highest[a] = max(highest[a], n)
        for g, own in zip(groups, links):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            yield (
                sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
                sum(n for p, n in own.items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in own.items()),
                hashlib.sha256(text.encode()).hexdigest() if g else "",
            )


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.mark.parametrize("block", [1, 1 << 23])
def test_alignment_equals_the_plain_version(spark, plain, block):
    texts = texts_of(80, seed=7, long=300)
    texts += texts[-12:] * 3 + ["the same text"] * 40
    rows = token_links.measured(frame(spark, texts), block=block).collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}
    assert len(rows) == len(texts)
    assert got == dict(enumerate(plain.measures(texts)))


def test_groups_of_a_text(plain):
    for text in texts_of(150, seed=8):
        assert token_links.aligned(text) == plain.groups(text)


def test_large_groups_are_counted_by_distinct_ids(plain, monkeypatch):
    texts = [t for t in texts_of(60, seed=9) if t]
    want = token_links.Aligner().texts(texts)
    monkeypatch.setattr(token_links, "LINKS", 1)
    got = token_links.Aligner().texts(texts)
    for key in ("times", "pair_counts", "digest", "n_links"):
        assert list(got[key]) == list(want[key])


def test_alignment_of_nothing(spark):
    rows = token_links.measured(frame(spark, [None, "", "▁", None])).collect()
    assert len(rows) == 4 and {tuple(r)[1:] for r in rows} == {(0, 0, 0, 0, 0, 0, "")}
    assert token_links.measured(frame(spark, ["x"]).limit(0)).count() == 0
    null_ids = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_a for r in token_links.measured(null_ids).collect()) == [0, 2, 2]


# --- periodic runs ------------------------------------------------------------------------

def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        x = 0
        while x < n - q:
            y = x
            while y < n - q and words[y] == words[y + q]:
                y += 1
            if y + q - x >= max(12, 2 * q):
                found.setdefault((x, y + q), q)
            x = y + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def repeating(seed, count):
    pick = random.Random(seed)
    for _ in range(count):
        n = pick.choice([0, 1, 11, 12, 13, 40, 150, 400])
        words = [str(pick.randrange(pick.choice([1, 2, 3, 30]))) for _ in range(n)]
        for _ in range(pick.randrange(3)):
            if n > 12:
                i = pick.randrange(n)
                p = 1 + pick.randrange((n - i) // 2 + 1)
                m = pick.randrange(n - i + 1)
                words[i : i + m] = (words[i : i + p] * (m // p + 1))[:m]
        yield words


def test_differences_are_exact():
    numbers = np.random.default_rng(1)
    for length, span in ((2, 8), (4, 11), (16, 47), (64, 200)):
        blocks = numbers.integers(0, 2000, (6, length)).astype(np.uint64)
        windows = numbers.integers(0, 2000, (6, span)).astype(np.uint64)
        got = repeats.differences(blocks, windows)
        for r in range(6):
            want = [int(((blocks[r].astype(int) - windows[r, k : k + length].astype(int)) ** 2).sum()) for k in range(span - length + 1)]
            assert got[r].tolist() == want


def test_runs_equal_the_plain_version():
    for words in repeating(3, 250):
        got = repeats.runs_of(repeats.numbered([[w.encode() for w in words]]))
        assert [tuple(r) for r in got.tolist()] == plain_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80))
def test_runs_of_small_alphabets(symbols):
    got = repeats.runs_of(np.array(symbols, dtype=np.int64))
    assert [tuple(r) for r in got.tolist()] == plain_runs(symbols)


def test_runs_query(spark):
    texts = [" \t".join(w) for w in repeating(4, 150)] + [None, "", "   x", "a " * 5000, None]
    rows = repeats.digests(repeats.periodic_runs(frame(spark, texts), repeats.planted)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        words = [w.decode() for w in (texts[row.doc_id] or "").encode().split()]
        words = plain_planted(row.doc_id, words)
        runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_runs_of_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "x y " * 30), (None, "x y " * 30)], "doc_id long, text string")
    rows = repeats.periodic_runs(df, repeats.planted).collect()
    assert [[tuple(r) for r in row.runs] for row in rows] == [[(0, 60, 2)]] * 2 and rows[0].collapsed == "x y"
    assert repeats.digests(repeats.periodic_runs(df.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not mounted")
def test_new_queries_on_the_smallest_tables(spark, library, plain):
    from shelfwise.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in queries.op13_tree_bpe(spark, folder).collect():
        ids = encode(library, docs[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    order = list(docs)
    want = dict(zip(order, plain.measures([docs[d] for d in order])))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_token_alignment(spark, folder).collect()}
    assert got == want


def test_texts_are_aligned_in_small_pieces():
    batch = pa.record_batch({"text": ["x" * 100_000] * 40})
    cut = [b.column(0).nbytes for b in token_links.pieces(iter([batch]), 0, token_links.AT_ONCE)]
    assert len(cut) > 6 and max(cut) <= token_links.AT_ONCE + 200_000 and sum(len(b) for b in token_links.pieces(iter([batch]), 0, 1)) >= 40

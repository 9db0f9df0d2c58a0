"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import math
import re
import struct

import numpy as np
import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def shingles(text):
    words = [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_components(docs):
    """{doc_id: smallest id reachable} over all pairs."""
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in root}


def edit_distance(item, text):
    """Least edits of ``item`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    return sorted(found, key=lambda s: (s[0], order.index(s[1])))


def part_distance(item, text):
    """:func:`edit_distance`, a whole row of its table at a time."""
    codes, at = np.array([ord(c) for c in text], dtype=np.int64), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, c in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)])
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


WORD64 = (1 << 64) - 1
TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\x20\x09-\x0D0-9A-Za-z_\x80-\xff]+")


def mix64(x):
    x &= WORD64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & WORD64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & WORD64
    return x ^ (x >> 31)


def token_hash(token):
    total, power = 0, 1
    for byte in token.lower():
        total += mix64((byte + 1) * 0xD6E8FEB86659FD93) * power
        power = power * 0x9E3779B97F4A7C15 & WORD64
    return mix64(total)


def shape_of(token):
    kinds = ((rb"[A-Z]", 1), (rb"[a-z]", 2), (rb"[0-9]", 4), (rb"[\x80-\xff]", 8), (rb"[^A-Za-z0-9\x80-\xff]", 16))
    return sum(bit for pattern, bit in kinds if re.search(pattern, token))


def gram_counts(text, buckets):
    """How often each bucket's n-grams occur: one and two tokens, one to three token shapes."""
    found, before, tokens, shapes = collections.Counter(), None, [], []
    for token in TOKEN.findall((text or "").encode()):
        tokens.append(token_hash(token))
        shapes.append(mix64(shape_of(token) * 2 + (token.lower() == before) + 977))
        before = token.lower()
    for values, size, salt in ((tokens, 1, 1), (tokens, 2, 2), (shapes, 1, 3), (shapes, 2, 4), (shapes, 3, 5)):
        for i in range(len(values) - size + 1):
            total = sum((values[i + k] + salt) * (mix64(k + 1) | 1) for k in range(size))
            found[mix64(total + size) % buckets] += 1
    return found


def importance_resampled(docs, labels, buckets, seed):
    """Ids (one a row) that importance resampling keeps of ``docs`` (doc_id, text) by ``labels`` (doc_id, quality)."""
    said = collections.defaultdict(set)
    for doc_id, quality in labels:
        said[doc_id].add(quality)
    good = {i: q.pop() for i, q in said.items() if len(q) == 1}
    counts = [gram_counts(t, buckets) for _, t in docs]
    raw, target = [1.0] * buckets, [1.0] * buckets
    for (doc_id, _), grams in zip(docs, counts):
        for bucket, n in grams.items():
            raw[bucket] += n
            target[bucket] += n * (good.get(doc_id) == 1)
    scale = sum(raw) / sum(target)
    target = [t + r / scale * 0.1 for t, r in zip(target, raw)]
    ratio = [math.log(t / sum_t) - math.log(r / sum_r) for sum_t, sum_r in [(sum(target), sum(raw))] for t, r in zip(target, raw)]
    weights = [sum(n * ratio[b] for b, n in grams.items()) for grams in counts]
    known = collections.defaultdict(list)
    for (doc_id, _), weight in zip(docs, weights):
        if doc_id in good:
            known[doc_id].append(weight)
    marked = [(min(w), good[i]) for i, w in known.items()]
    best, cut, last = 9.0, None, None
    for value in [*sorted({w for w, _ in marked}), math.inf]:
        lost = sum(g for w, g in marked if w < value) / sum(g for _, g in marked)
        passed = sum(1 - g for w, g in marked if w >= value) / sum(1 - g for _, g in marked)
        if lost + passed < best - 1e-12:
            best, cut = lost + passed, value if last is None else last if value == math.inf else (last + value) / 2
        last = value

    def noise(doc_id):
        first = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)
        unit = ((xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=first) >> 11) + 0.5) / (1 << 53)
        return -math.log(-math.log(unit))

    scores = [w + noise(i) for (i, _), w in zip(docs, weights)]
    cutoff = sorted(scores, reverse=True)[sum(w >= cut for w in weights) - 1]
    return [i for (i, _), score in zip(docs, scores) if score >= cutoff - 1e-7]

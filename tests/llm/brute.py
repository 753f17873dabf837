"""Brute-force versions of the operators, in plain Python over small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text: bytes | str) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def exact(rows):
    """{doc_id: (keep_id, group_size, kept, sha)} of rows with unique doc_ids."""
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    return {i: (max(g), len(g), i == max(g), sha(t)) for t, g in by.items() for i in g}


def top_k(rows, is_query, k):
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in good:
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(good[q], good[i])), i) for i in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def repeats(rows, length):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)}."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def windows(rows, size):
    """{doc_id: (n_words, n_removed, sha)}."""
    ws = {i: words(t) for i, t in rows}
    first = {}
    for i in sorted(ws):
        for s in range(len(ws[i]) - size + 1):
            first.setdefault(tuple(ws[i][s : s + size]), i)
    out = {}
    for i, w in ws.items():
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < i:
                gone[s : s + size] = [True] * size
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def near(rows, percent, k=5):
    """{doc_id: (n_shingles, component_id, kept)}."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(lower))
        sets[i] = {tuple(w[s : s + k]) for s in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def ngrams(text):
    """1 to 3 characters, letters in simple lower case, all else as a space."""
    def simple(c):
        low = c.lower()
        return (low if len(low) == 1 else c) if c.isalpha() else " "

    t = "".join(map(simple, text))
    return [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]


def bucket(gram, buckets):
    mask, h = (1 << 64) - 1, 0
    for n, c in enumerate(gram, 1):
        h = (h * 0x9E3779B97F4A7C15 + (ord(c) + n) * 0xD6E8FEB86659FD93) & mask
    return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask) >> (64 - buckets.bit_length() + 1)


def language(model, text):
    """(language, score) of a text by a fitted model, gram by gram."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    grams = Counter(bucket(g, model.buckets) for g in ngrams(text))
    total = sum(grams.values())
    s = [(sum(float(model.table[b, k]) * n for b, n in grams.items()) / total + model.bias[k]) / model.temperature for k in range(len(model.langs))]
    p = [math.exp(x - max(s)) for x in s]
    return model.langs[p.index(max(p))], max(p) / sum(p)


def toxicity(model, entry_hashes, text):
    """Score of a text by a fitted model; entry_hashes gives the hashes of one word and its beginnings."""
    weight = dict(zip(model.vocabulary.tolist(), model.weights.tolist()))
    count = Counter(h for w in words(text) for h in entry_hashes(w))
    odds = model.bias + sum(weight[h] * math.log1p(n) for h, n in count.items() if h in weight)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def hilbert_place(cells, bits):
    """Place of a point on the Hilbert curve, by descending through the cube's orthants one bit at a time."""
    n = len(cells)
    x = list(cells)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def planted(doc_id, ws):
    """The words of a document after the planting of periods."""
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def runs(ws, min_length=12):
    """(start, length, period) of all maximal runs, by trying every period."""
    found, n = {}, len(ws)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            if j - i + q >= max(min_length, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return [(s, length, q) for (s, length), q in sorted(found.items(), key=lambda x: (x[0][0], x[1]))]


def run_digests(rows):
    """{doc_id: (n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)}."""
    out = {}
    for i, t in rows:
        ws = planted(i, words(t))
        found = runs(ws)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = min(((-length, s, q) for s, length, q in found), default=None)
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        out[i] = (len(found), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def clusters(rows, k=8, rounds=10, dims=64, scale=1024):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}") if r[0] is not None else "", r[1]))
    centers = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centers[j] = [sum(x) // len(vs) for x in zip(*vs)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    by = Counter()
    for _, j, d in last:
        by[j] += d
    return sorted(((i, j, d, by[j], sum(by.values()), sha(",".join(map(str, centers[j])))) for i, j, d in last), key=repr)

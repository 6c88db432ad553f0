"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def components(rows):
    """{row number: (set size, id of the component)} of (id, text) rows; ids may be null or repeat."""
    low = lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w)
    sets = []
    for _, text in rows:
        w = [low(x) for x in words(text)]
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    by = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    rank = {i: n for n, i in enumerate(order)}
    for i, s in enumerate(sets):
        for j, shared in collections.Counter(j for g in s for j in by[g] if j > i).items():
            if 100 * shared >= 80 * (len(s) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)), key=rank.get)
                parent[b] = a
    return [(rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows))]


def repeats(rows, window=20):
    """(id, number of words, number removed, kept words) of (id, text) rows in the order of their ids."""
    seen, out = set(), []
    for key, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone.update(range(i, i + window))
            seen.add(k)
        out.append((key, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def crc_ids(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha_ids(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def shards(rows, shards=16, seed=17):
    """{id: (shard, slot)} of (id, source) rows with distinct ids."""
    by = collections.defaultdict(list)
    for key, source in rows:
        by[source].append((hashlib.md5(f"{seed}:{key}".encode()).hexdigest(), key))
    placed = []
    for source, own in by.items():
        for r, (_, key) in enumerate(sorted(own)):
            placed.append(((r + 0.5) / len(own), source is not None, source or "", key))
    placed.sort()
    out, n = {}, len(placed)
    for p, (*_, key) in enumerate(placed):
        s = p * shards // n
        out[key] = (s, p - -(-s * n // shards))
    return out


def line_dedup(rows, least=10):
    """(id, lines, dropped, kept text) of (id, text) rows; ids may be null (the smallest) or repeat."""
    blanks = " \t\n\x0b\x0c\r"
    lower = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x)
    split = [(key is not None, key, (text or "").split("\n")) for key, text in rows]
    holders = collections.defaultdict(set)
    for there, key, lines in split:
        for line in lines:
            holders[lower(line.strip(blanks))].add((there, key or 0))
    out = []
    for there, key, lines in split:
        kept = [x for x in lines if len(x.strip(blanks)) < least or min(holders[lower(x.strip(blanks))]) == (there, key or 0)]
        out.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def collocations(rows, least=100, top=2000, contained=100):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in candidates.items():
            parts = {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}
            dropped |= {q for q in parts if 100 * a >= contained * f[q]}
        best = []
        for p in candidates.keys() - dropped:
            a = candidates[p]
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def whitened(vectors, k=8):
    """n, deviations, whitened entries and explained shares of integer rows (any sign)."""
    x = np.array(vectors, object)
    n, sums = len(x), x.sum(0)
    deviation = [int(v) for v in ((n * x - sums) ** 2).sum(1)]
    centred = ((n * x - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, deviation, centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)

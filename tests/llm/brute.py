"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def roots(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def tokens(docs, path, pattern):
    """docs: (doc_id, text) in order of doc_id."""
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(path), 0, {}
    t.encode_special_tokens = True
    for doc, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def shingle_set(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def jaccard(docs, k, percent):
    sets = [(d, shingle_set(t, k)) for d, t in docs]
    lists, links, degree = defaultdict(list), [], Counter()
    for i, (_, s) in enumerate(sets):
        shared = Counter(j for x in s for j in lists[x])
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                links.append((i, j))
                degree[i] += 1
                degree[j] += 1
        for x in s:
            lists[x].append(i)
    root = roots(range(len(sets)), links)
    least: dict = {}
    for i, (d, _) in enumerate(sets):
        least[root[i]] = min(d, least.get(root[i], d))
    return [(d, len(s), degree[i], least[root[i]]) for i, (d, s) in enumerate(sets)]


def repeats(docs, length):
    starts = defaultdict(list)
    data = [(d, (t or "").encode()) for d, t in docs]
    for i, (_, b) in enumerate(data):
        for p in range(len(b) - length + 1):
            starts[hashlib.blake2b(b[p : p + length], digest_size=16).digest()].append((i, p))
    covered = [np.zeros(len(b), bool) for _, b in data]
    for places in starts.values():
        if len(places) > 1:
            for i, p in places:
                covered[i][p : p + length] = True
    out = []
    for (d, b), c in zip(data, covered, strict=True):
        runs = int((np.diff(np.concatenate([[0], c.astype(np.int8)])) == 1).sum())
        out.append((d, len(b), int(c.sum()), runs, sha(np.frombuffer(b, np.uint8)[~c].tobytes())))
    return out


def cosine_links(vectors, least):
    """vectors: (vec_id, list or None, label or None)."""
    ok = [i for i, (_, v, label) in enumerate(vectors) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x for x in v)]
    degree, links = Counter(), []
    by = defaultdict(list)
    for i in ok:
        by[vectors[i][2], len(vectors[i][1])].append(i)
    for rows in by.values():
        x = np.array([vectors[i][1] for i in rows], np.float64)
        x /= np.sqrt((x * x).sum(1))[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            links.append((rows[a], rows[b]))
            degree[rows[a]] += 1
            degree[rows[b]] += 1
    root = roots(range(len(vectors)), links)
    smallest: dict = {}
    for i, (v, _, _) in enumerate(vectors):
        smallest[root[i]] = min(v, smallest.get(root[i], v))
    return [(v, degree[i], smallest[root[i]]) for i, (v, _, _) in enumerate(vectors)], links


def mix_targets(sizes: dict):
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}
    target, left, open_ = {s: Fraction(0) for s in sizes}, Fraction(3 * sum(sizes.values()), 2), {s for s in sizes if sizes[s]}
    while open_:
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > 2 * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            open_.remove(s)
        left -= sum(target[s] for s in over)
    return target


SECRETS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(text):
    t = text or ""
    found = []
    for k, (kind, rx) in enumerate(SECRETS.items()):
        for m in rx.finditer(t):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                found.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]

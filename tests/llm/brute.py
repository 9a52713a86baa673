"""Plain restatements of what the operators return, for small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, width=5):
    w = WORDS.findall(lower(t))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard_components(rows):
    """rows (id, text) -> {id: (n_shingles, component)}; ids distinct."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for i, s in sets.items():
        near = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j < i:
                    near[j] += 1
        for j, common in near.items():
            if 100 * common >= 80 * (len(s) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def secrets(t):
    t, found = t or "", []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", t):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end(), "hex"))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """sizes {source: words} -> {source: target}, by clamping again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            out[s] = float(epochs * sizes[s])
            left -= epochs * sizes[s]
        open_ -= over
    return out


def archive_rows(pages):
    """pages (page_id, html) -> rows as op7 returns them."""
    top = {}
    for i, h in pages:
        top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, h in pages:
        p = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), d, "response" if top[h or ""] == i else "revisit", None if top[h or ""] == i else top[h or ""]))
    return out


def media_row(t):
    raw = (t or "").encode()
    p = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
    m = f"P5\n64 {len(p) // 64}\n255\n".encode() + p
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()


def top_k(vectors, k=10):
    good = {i: [math.floor(1024 * x) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in good.items():
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out

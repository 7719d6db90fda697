"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def licenses(docs):
    out = {}
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        starts = [i for i, _ in at]
        out[doc_id] = (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
    return out


def repeats(docs, width=35):
    words = {d: SPACED.findall(t or "") for d, t in docs}
    seen = Counter(tuple(w[i : i + width]) for w in words.values() for i in range(len(w) - width + 1))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def leaks(docs, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(item)
    sizes = {len(k) for k in windows}
    out = {}
    for d, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def _classes(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width=5):
    w = SPACED.findall(lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1) if w else 0)}


def jaccard_classes(docs):
    sets = {d: shingles(t) for d, t in docs}
    postings = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            postings[x].add(d)
    links = set()
    for d, s in sets.items():
        overlap = Counter(e for x in s for e in postings[x] if e < d)
        links |= {(d, e) for e, n in overlap.items() if 100 * n >= 75 * (len(s) + len(sets[e]) - n)}
    roots = _classes(sets, links)
    return {d: (len(s), roots[d]) for d, s in sets.items()}


def vector_classes(vectors, least=0.95):
    import numpy as np

    good = {i: np.asarray(v, dtype=float) for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least]
    roots, n = _classes([i for i, _ in vectors], links), Counter(x for l in links for x in l)
    return {i: (n[i], roots[i], roots[i] == i) for i, _ in vectors}


def chats(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def archive(pages):
    last = {}
    for page, html in pages:
        last[html or ""] = max(page, last.get(html or "", page))
    out = {}
    for page, html in pages:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = last[html or ""]
        out[page] = (len(body), digest, "response" if page == first else "revisit", None if page == first else first)
    return out


def line_keepers(docs, threshold=0.75, k=10):
    """{(doc_id, line_no): kept}: exact classes of lines by the Jaccard index of their character shingles."""
    places, sets = defaultdict(list), {}
    for d, t in docs:
        for n, raw in enumerate((t or "").split("\n")):
            if line := raw.strip(" \t\r\f\x0b"):
                places[line].append((d, n))
                units = line.encode("utf-16-be")
                sets[line] = {units[2 * i : 2 * (i + k)] for i in range(max(1, len(units) // 2 - k + 1))}
    postings = defaultdict(list)
    for line, s in sets.items():
        for x in s:
            postings[x].append(line)
    links = []
    for line, s in sets.items():
        overlap = Counter(e for x in s for e in postings[x] if e < line)
        links += [(line, e) for e, n in overlap.items() if n >= threshold * (len(s) + len(sets[e]) - n)]
    roots = _classes(sets, links)
    first = {}
    for line, at in places.items():
        r = roots[line]
        first[r] = min(at + ([first[r]] if r in first else []))
    return {p: first[roots[line]] == p for line, at in places.items() for p in at}

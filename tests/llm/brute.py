"""Plain versions of the operators' rules, for small tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def listed(found, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))


def pii(text):
    t, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return listed(out, ["email", "ip", "card", "phone"])


def secrets(text):
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return listed(out, ["assign", "access", "hex"])


def word_spans(rows, k=13):
    """doc_id -> (n_words, n_removed, digest); ids are distinct."""
    first, words = {}, {}
    for i, t in sorted(rows):
        w = words[i] = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def byte_spans(rows, k=100):
    """doc_id -> (n_bytes, n_removed, n_spans, digest); ids are distinct."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - k + 1):
            piece = b[j : j + k]
            if piece in seen:
                gone[j : j + k] = True
            seen.add(piece)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def gram_links(rows, threshold=0.8, n=5):
    """(links per doc_id, component per doc_id) of all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    both = Counter(p for h in holders.values() for p in itertools.combinations(sorted(h), 2))
    links = [(a, b) for (a, b), c in both.items() if c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9]
    return Counter(x for p in links for x in p), components(sets, links)


def vector_links(rows, threshold=0.93):
    """(links per vec_id, component per vec_id) of all pairs with equal labels."""
    good = []
    for i, v, label in rows:
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good.append((i, x / np.linalg.norm(x), label))
    links = [(a[0], b[0]) for a, b in itertools.combinations(good, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= threshold]
    return Counter(x for p in links for x in p), components([r[0] for r in rows], links)


def spot_signatures(text, anchors):
    """Signatures as strings: every anchor with the three content words after it."""
    words = re.findall(r"\w+", text.lower())
    content = [k for k, w in enumerate(words) if w not in anchors]
    if len(content) in (0, len(words)):
        return {" ".join(["", *words[k : k + 3]]) for k in range(len(words))}
    return {" ".join([w, *[words[c] for c in content if c > k][:3]]) for k, w in enumerate(words) if w in anchors}


def spot_print(sigs):
    hashes = sorted({zlib.crc32(s.encode()) for s in sigs})
    return f"{len(hashes)}:" + "".join(f"{h:08x}" for h in hashes)


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0

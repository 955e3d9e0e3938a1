"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def repeats(docs, depth=50):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    docs, first = [(i, (t or "").encode()) for i, t in docs], {}
    for i, t in docs:
        for j in range(len(t) - depth + 1):
            first[t[j : j + depth]] = min(i, first.get(t[j : j + depth], i))
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for j in range(len(t) - depth + 1):
            if first[t[j : j + depth]] < i:
                gone[j : j + depth] = b"\1" * depth
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return sorted(out)


def simhash(text, n=4):
    w = words(text)
    spans = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if spans else 0


def near(docs, radius=4):
    fps = [(i, simhash(t)) for i, t in docs]
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a][1] ^ fps[b][1]).bit_count() <= radius and label[b] > label[a]:
                    label[b], changed = label[a], True
    least = {}
    for (i, _), lab in zip(fps, label):
        least[lab] = min(i, least.get(lab, i))
    return sorted((i, f"{fp:016x}", least[lab]) for (i, fp), lab in zip(fps, label))


def unigrams(docs):
    """{doc_id: (held_out, n_tokens, n_known, N, base_score)}."""
    tokens = {i: [*words(t), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {
        i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        for i, ws in tokens.items()
    }


def shingles(text, n=5):
    w = words(text)
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def lines(docs, least):
    """{doc_id: text without later copies of line runs of ``least`` characters}; docs in the order of their ids."""
    split, first = [t.split("\n") for _, t in docs], set()
    gone = [set() for _ in docs]
    for d, own in enumerate(split):
        for i in range(len(own)):
            for w in range(1, len(own) - i + 1):
                key = tuple(own[i : i + w])
                if key not in first:
                    first.add(key)
                elif sum(map(len, key)) >= least:
                    gone[d].update(range(i, i + w))
    return {i: "\n".join(x for k, x in enumerate(split[d]) if k not in gone[d]) for d, (i, _) in enumerate(docs)}


def secrets(text):
    """Base spans as text, and per kind."""
    text = text or ""
    found = []
    for kind, (pattern, flags, ok) in enumerate((
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    )):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if ok(m)]
    names = ("assign", "access", "hex")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found)), Counter(names[k] for _, k, _ in found)

"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def least(i):
    return -(2**63) if i is None else i


def substring_dedup(docs, length):
    first = {}
    words = [(least(i), WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        for a in range(len(w) - length + 1):
            k = tuple(w[a : a + length])
            first[k] = min(first.get(k, (i, a)), (i, a))
    out = []
    for (i, w), (raw, _) in zip(words, docs):
        gone = set()
        for a in range(len(w) - length + 1):
            if first[tuple(w[a : a + length])] < (i, a):
                gone.update(range(a, a + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((raw, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix_dedup(docs, length):
    least_doc = {}
    data = [(least(i), (t or "").encode()) for i, t in docs]
    for i, b in data:
        for a in range(len(b) - length + 1):
            k = b[a : a + length]
            if least_doc.get(k, i) >= i:
                least_doc[k] = i
    out = []
    for (i, b), (raw, _) in zip(data, docs):
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if least_doc[b[a : a + length]] < i:
                gone[a : a + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((raw, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def decontaminate(docs, items, n):
    windows = {}
    for item, t in items:
        w = BENCH_WORD.findall((t or "").translate(LOW))
        if w:
            k = min(n, len(w))
            for a in range(len(w) - k + 1):
                windows.setdefault(tuple(w[a : a + k]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w = BENCH_WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                own = windows.get(tuple(w[a : a + k]))
                if own:
                    hit.update(range(a, a + k))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out

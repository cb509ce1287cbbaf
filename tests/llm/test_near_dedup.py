"""Operator 8 against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import near_dedup as N

from . import brute
from .conftest import rows_of

LOW = brute.LOW


def weights(text, width=5):
    w = [x.translate(LOW) for x in brute.WORD.findall(text or "")]
    if not w:
        return Counter()
    if len(w) < width:
        return Counter([tuple(w)])
    return Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def similar(x, y):
    common = x.keys() & y.keys()
    if not common:
        return 0.0
    plain = len(common) / len(x.keys() | y.keys())
    every = x.keys() | y.keys()
    return max(plain, sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in common))


def classes(docs, threshold=0.8):
    own = [weights(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if own[i] and (docs[i][1] == docs[j][1] or similar(own[i], own[j]) >= threshold):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    size = Counter(find(i) for i in range(len(docs)))
    return [(d, least[find(i)] if own[i] else d, size[find(i)] if own[i] else 1) for i, (d, _) in enumerate(docs)]


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    docs = []
    for i in range(n):
        if docs and r.random() < 0.6:
            w = r.choice(docs)[1].split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
                w = w or ["one"]
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], [word()], [word(), word()], [w[at].upper()]])
        else:
            w = [word() for _ in range(r.choice([1, 3, 4, 5, 9, 60, 130, 200]))]
            if r.random() < 0.3:
                w = w * r.randint(2, 4)
        docs.append((i, " ".join(w) or "x"))
    return docs + [(900, None), (901, ""), (902, " \n"), (902, " \n"), (903, docs[7][1]), (903, docs[7][1]), (None, docs[8][1]), (5, docs[9][1]), (904, docs[11][1].replace(" ", "\n\t"))]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, node string, class int").repartition(4)
    got = N.near_dedup(df).collect()
    assert sorted([(r.doc_id, r.class_id, r.class_size) for r in got], key=str) == sorted(classes(docs), key=str)
    worded = {r.class_id for r in got if r.node is not None}
    assert {r.doc_id for r in got if r.kept and r.node is not None} == worded
    assert len({(r.doc_id, bytes(r.node)) for r in got if r.kept and r.node is not None}) == len({(r.class_id, r.class_size, bytes(r.node) if r.doc_id in (5, 903) else b'') for r in got if r.kept and r.node is not None})
    left = N.without_near_copies(df)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect() if (r.text or "").strip()} == worded


def test_links_across_stars(spark):
    """A chain of near copies, each only near its neighbours, is one class whichever node is the star's centre."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    w = [word() for _ in range(300)]
    docs = [(0, " ".join(w))]
    for i in range(1, 12):
        for k in range(3):
            w[(i * 25 + k * 8) % 300] = word()
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(tuple(x)[:3] for x in rows_of(N.near_dedup(df))) == sorted(classes(docs))


def test_copies_that_repeat_a_line(spark):
    """Distinct shingles are nearly the same, but one copy has a line many times."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    docs = []
    for i in range(12):
        text, line = " ".join(word() for _ in range(150)), " ".join(word() for _ in range(14))
        docs += [(2 * i, f"{text} {line}"), (2 * i + 1, " ".join([text, *[line] * 20]))]
    assert len({c for _, c, _ in classes(docs)}) == 12
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(tuple(x)[:3] for x in rows_of(N.near_dedup(df))) == sorted(classes(docs))


def test_either_signature_is_near():
    r = np.random.default_rng(6)
    sets = np.sort(r.integers(0, 2**32 - 1, 200)).astype("<u4").tobytes()
    sig = [r.integers(0, 2**32 - 1, 125).astype(np.uint32).tobytes() for _ in range(2)]
    keys = N.band_keys(np.frombuffer(sig[0], np.uint32)[None, :], N.BANDS, N.ROWS)[0].tolist()
    # the pair is compared in its first shared band only
    for flat, key, links in (([None, sig[0]], keys[0], 1), ([None, sig[0]], keys[3], 0), ([None, None], keys[0], 0)):
        rows = {"key": [key] * 2, "node": [b"a", b"b"], "label": [b"a", b"b"], "block": [0, 0], "bi": [0, 0], "bj": [0, 0], "sig": sig, "flat": flat, "keys": [sets, sets], "weights": [b"", np.r_[np.ones(199), 900].astype("<u4").tobytes()]}
        assert N._across(N.ESTIMATE, N.THRESHOLD, N.ROWS)(N.pa.table(rows)).num_rows == links


def test_registers_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**64 - 1, 400, dtype=np.uint64)
    h.sort()
    x, y = r.integers(1, 9, 300), r.integers(1, 9, 300)
    doc = np.repeat([0, 1], 300)
    sig = N.signatures(doc, np.concatenate([h[:300], h[100:]]), np.concatenate([x, y]), 2, 4000)
    exact = similar(Counter(dict(zip(h[:300].tolist(), x.tolist()))), Counter(dict(zip(h[100:].tolist(), y.tolist()))))
    common = N.similarity(h[:300] >> np.uint64(32), x, h[100:] >> np.uint64(32), y)
    assert common == pytest.approx(exact)
    both = sum(1 / (np.maximum(np.r_[x / a, np.zeros(100)], np.r_[np.zeros(100), y / b]).sum()) for a, b in zip(x[100:], y[:200]))
    assert (sig[0] == sig[1]).mean() == pytest.approx(both, abs=0.04)


def test_bounds():
    r = np.random.default_rng(2)
    sets = [np.sort(r.choice(60, r.integers(3, 50), replace=False)).astype(np.uint32) for _ in range(30)]
    weights = [None if i % 3 == 0 else r.integers(1, 3 if i % 3 == 1 else 9, len(s)).astype(np.uint32) for i, s in enumerate(sets)]
    one = [np.ones(len(s), np.uint32) if w is None else w for s, w in zip(sets, weights)]
    plain, most = N.bounds(sets, weights, columns=16)
    for i in range(30):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert plain[i, j] == pytest.approx(len(a & b) / len(a | b), abs=1e-6)
            assert N.similarity(sets[i], one[i], sets[j], one[j]) <= most[i, j] + 1e-6


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert N.near_dedup(none).count() == 0 and N.without_near_copies(none).count() == 0

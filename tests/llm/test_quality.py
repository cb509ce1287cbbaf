"""Operator 6: counts against a plain version, models by held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import quality as Q

from . import brute
from .test_text_passes import corpus


def brute_counts(text):
    t = text or ""
    w = brute.WORD.findall(t)
    lines = [x for x in t.split("\n") if brute.WORD.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_base_counts(spark):
    r = random.Random(0)
    docs = corpus(8) + [(400 + i, "\n".join(r.choice(["", " ", "aé #", "aé # ", "x y z |", "日本 <b> 日本"]) for _ in range(30))) for i in range(20)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, kept int").repartition(3)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = Q.quality_rules(df, none).collect()
    assert sorted([tuple(x)[:7] for x in got], key=str) == sorted([(i, *brute_counts(t)) for i, t in docs], key=str)
    assert all(x.kept == (not x.base_failed) and x.p_quality is None for x in got)
    assert Q.quality_rules(df.limit(0), none).count() == 0


def labelled(n, seed):
    r = random.Random(seed)
    nice = ["".join(r.choice("abcdeiorst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [r.choice(nice) for _ in range(r.randint(30, 120))]
        bad, toxic = r.random() < 0.3, r.random() < 0.25
        if bad:
            w = [x.upper() + r.choice(["!!", "$$$"]) for x in w]
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["grot", "vile"]))
        rows.append((i, " ".join(w), int(not bad), int(toxic)))
    return rows


def test_models_hold_out(spark):
    rows = labelled(700, 2)
    docs = spark.createDataFrame([x[:2] for x in rows] + [(None, None), (3, None)], "doc_id bigint, text string").repartition(3)
    labels = [(i, q, t) for i, _, q, t in rows if i % 2] + [(1, None, None), (None, 0, 1)]
    got = {x.doc_id: x for x in Q.quality_rules(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect() if x.n_words}
    held = [x for x in rows if x[0] % 2 == 0]
    right = np.mean([got[i].kept == bool(q and not t) for i, _, q, t in held])
    assert right > 0.95
    p = np.array([got[i].p_quality for i, *_ in held])
    assert abs(p.mean() - np.mean([q for _, _, q, _ in held])) < 0.05


def test_toxic_words_in_many_forms():
    """Each toxic text has a form of its own of one stem, so no word tells."""
    r = random.Random(4)
    some = lambda: "".join(r.choice("abcdeiorst") for _ in range(5))
    text, y = [], np.array([i % 3 == 0 for i in range(600)]).astype(int)
    for toxic in y:
        w = [some() for _ in range(40)]
        if toxic:
            w[7], w[30] = (some() + "zwylk" + some() for _ in range(2))
        text.append(" ".join(w))
    column = lambda x, t: Q.pa.array(x, t)
    columns = [column(range(400), Q.pa.int64()), column(text[:400], Q.pa.string()), column(range(400), Q.pa.int64()), column(y[:400], Q.pa.int32()), column(y[:400], Q.pa.int32())]
    batch = Q.pa.RecordBatch.from_arrays(columns, names=["id", "text", "order", "quality", "toxic"])
    rows = Q.pa.Table.from_batches(list(Q._features([batch])))
    model = Q.train("toxic", y[:400], [np.frombuffer(x, "<u4") for x in rows.column("feature").to_pylist()], [np.frombuffer(x, "<f4") for x in rows.column("value").to_pylist()])
    p = Q.judge(*Q.utf8(column(text[400:], Q.pa.string())), {"quality": None, "toxic": model}, (Q.THRESHOLD_QUALITY, Q.THRESHOLD_TOXIC))[2]["toxic"]
    assert ((p >= Q.THRESHOLD_TOXIC) == y[400:]).mean() > 0.95


def test_platt_calibrates():
    r = np.random.default_rng(3)
    score = r.normal(0, 2, 4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.5 * score - 1)))).astype(int)
    a, b = Q.platt(score, y)
    assert a == pytest.approx(0.5, abs=0.06) and b == pytest.approx(-1, abs=0.12)

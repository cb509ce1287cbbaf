"""Quality rules (operator 6).

Counts of each text come first, and fixed rules on them.  What they let pass
is judged by hashed logistic regressions: the features are the words of a text
(lower-cased, present or not) and its character n-grams (as shares of all),
hashed to fixed tables.  One model learns the quality label and one the toxic
label, from a bounded sample of labelled rows (`fit_rows` documents, those of
the least id hashes); features are made on the executors and only their hashes
come to the driver.  A fifth of the sample, kept out of the fit, calibrates
the models' outputs to probabilities (Platt), and fixed thresholds decide.  The
weights, of fixed size, are broadcast and texts are scored in Arrow batches.

A very long text is a slice by itself; no part of it is left out.

Nulls have no words.  Null or repeated ids give a row each; labels that disagree
for an id count as the worst of them, and null labels are ignored.  With fewer than
`MIN_CLASS` rows of either class a model is left out and says nothing.  An empty
table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE2, CHUNK_BYTES, SPACE, Words, covered, id_array, ids_of, lean, mix, ordered_spans, row_filter, ship, slices, utf8, windows

#: Fixed values of the contract.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8

WORD_BITS, GRAM_BITS, GRAM = 18, 17, 3
FEATURES = (1 << WORD_BITS) + (1 << GRAM_BITS)
#: Bytes of text that are judged together: their features take about sixty times that.
JUDGE_BYTES = 1 << 19
#: Labelled rows that a fit takes at most; rows of a class below which there is no fit.
FIT_ROWS, MIN_CLASS = 4_000, 10
#: A share of n-grams weighs this much against a word's presence.
GRAM_SCALE, WORD_SCALE = 20.0, {"quality": 0.25, "toxic": 1.0}
#: A word is used if it is in so many rows and its classes differ by so many deviations.
MIN_ROWS, MIN_Z = 4, 4.5
THRESHOLD_QUALITY, THRESHOLD_TOXIC = 0.4, 0.5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
U64 = np.uint64

SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, p_quality double, p_toxic double"


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the places [offsets[i], offsets[i+1]) are set."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def counts(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, dict[str, np.ndarray]]:
    """The base counts of each text."""
    w = Words(data, offsets, ~SPACE)
    starts_char = (data & 0xC0) != 0x80
    # lines with a word
    newline = np.flatnonzero(data == 0x0A)
    begin = np.concatenate([offsets[:-1], newline + 1])
    end = np.concatenate([newline, offsets[1:]])
    begin, end = np.sort(begin, kind="stable"), np.sort(end, kind="stable")
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end = begin[worded], end[worded]
    doc = np.searchsorted(offsets, begin, "right") - 1
    line = np.stack([doc.astype(U64), ordered_spans(data, begin, end)])
    order = np.lexsort(line)
    line = line[:, order]
    again = np.zeros(len(order), bool)
    again[1:] = (line[:, 1:] == line[:, :-1]).all(axis=0)
    n_dup = np.bincount(line[0][again].astype(np.int64), minlength=len(w.count))
    # windows found twice in a text
    repeated = np.zeros(len(w), bool)
    if len(w) >= REPEAT_WINDOW:
        h = windows(w.hashes(), REPEAT_WINDOW)
        at = np.flatnonzero(np.arange(len(h)) + REPEAT_WINDOW <= np.repeat(w.first[1:], w.count)[: len(h)])
        own = np.searchsorted(w.first, at, "right").astype(U64) - U64(1)
        key = h[at] ^ mix(own + U64(1))
        order = np.argsort(key, kind="stable")
        same = (key[order][1:] == key[order][:-1]) & (own[order][1:] == own[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        repeated = covered(len(w), at[twice], at[twice] + REPEAT_WINDOW)
    return w, {
        "n_words": w.count,
        "word_chars": per_doc(starts_char & ~SPACE[data], offsets),
        "n_symbols": per_doc(SYMBOLS[data], offsets),
        "n_dup_lines": n_dup,
        "n_repeat_words": per_doc(repeated, w.first),
    }


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])


def word_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, word feature) pairs, sorted."""
    h = ordered_spans(LOWER[w.data], w.start, w.end, BASE2) >> U64(64 - WORD_BITS)
    pair = np.unique(w.doc().astype(U64) << U64(WORD_BITS) | h)
    return (pair >> U64(WORD_BITS)).astype(np.int64), (pair & U64((1 << WORD_BITS) - 1)).astype(np.int64)


def gram_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all character n-grams in order, the document of each, and how many each document has."""
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    if len(chars) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    h = np.zeros(len(chars) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        h = h * np.uint32(0x01000193) + chars[k : k + len(h)] * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[: len(h)]
    inside = np.arange(len(h)) + GRAM <= first[1:][doc]
    return ((h[inside] >> np.uint32(32 - GRAM_BITS)).astype(np.int64)) + (1 << WORD_BITS), doc[inside], np.maximum(np.diff(first) - GRAM + 1, 0)


def _features(batches):
    """Rows of the sample: labels, the word features and the n-gram features with their shares."""
    for piece in slices(batches, CHUNK_BYTES):
        data, offsets = utf8(piece.column(1))
        w = Words(data, offsets, ~SPACE)
        wd, wf = word_features(w)
        gf, gd, n = gram_features(data, offsets)
        out = []
        word_at, gram_at = np.searchsorted(wd, np.arange(len(offsets))), np.searchsorted(gd, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            own, times = np.unique(gf[gram_at[i] : gram_at[i + 1]], return_counts=True)
            words = wf[word_at[i] : word_at[i + 1]]
            feature = np.concatenate([words, own]).astype("<u4")
            value = np.concatenate([np.ones(len(words)), GRAM_SCALE * times / max(1, n[i])]).astype("<f4")
            out.append((feature.tobytes(), value.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [piece.column(2), piece.column(3), piece.column(4), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())],
            names=["order", "quality", "toxic", "feature", "value"],
        )


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """Sparse rows."""

    def __init__(self, feature: list[np.ndarray], value: list[np.ndarray]):
        self.feature = np.concatenate(feature) if feature else np.zeros(0, np.int64)
        self.value = np.concatenate(value) if value else np.zeros(0)
        self.row = np.repeat(np.arange(len(feature)), [len(x) for x in feature])
        self.n = len(feature)

    def times(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weight[self.feature] * self.value, self.n)

    def transposed(self, x: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, x[self.row] * self.value, size)


def fit(rows: Rows, y: np.ndarray, l2: float = 2e-4, rounds: int = 150, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with classes weighed evenly, by Adam on all rows."""
    used, feature = np.unique(rows.feature, return_inverse=True)
    own = Rows([], [])
    own.feature, own.value, own.row, own.n = feature, rows.value, rows.row, rows.n
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):
        error = (_sigmoid(own.times(w) + b) - y) * share
        g, gb = own.transposed(error, len(used)) + l2 * w, error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    out = np.zeros(FEATURES)
    out[used] = w
    return out, float(b)


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * score + shift) a probability."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = _sigmoid(a * score + b)
        d, s = p - target, p * (1 - p) + 1e-9
        ga, gb = (d * score).sum() + 1e-3 * (a - 1), d.sum()
        haa, hab, hbb = (s * score * score).sum() + 1e-3, (s * score).sum(), s.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        step = np.clip([(hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det], -1, 1)
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)


def telling(feature: list, y: np.ndarray) -> np.ndarray:
    """Which features a model may use: words whose share of documents differs between the classes by MIN_Z deviations, and all n-grams."""
    good, bad = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    words = [x[x < 1 << WORD_BITS] for x in feature]
    label = np.repeat(y, [len(x) for x in words])
    words = np.concatenate(words) if words else np.zeros(0, np.int64)
    in_good, in_bad = np.bincount(words[label == 1], minlength=1 << WORD_BITS), np.bincount(words[label == 0], minlength=1 << WORD_BITS)
    p = (in_good + in_bad + 0.5) / (good + bad + 1)
    z = (in_good / good - in_bad / bad) / np.sqrt(p * (1 - p) * (1 / good + 1 / bad) + 1e-12)
    return np.concatenate([(np.abs(z) >= MIN_Z) & (in_good + in_bad >= MIN_ROWS), np.ones(1 << GRAM_BITS, bool)])


def train(head: str, y: np.ndarray, feature: list, value: list) -> tuple[np.ndarray, float, float, float] | None:
    """Weights, bias, slope and shift; None if a class is too small.  Rows come in the order of their id hashes."""
    if min(y.sum(), len(y) - y.sum()) < MIN_CLASS:
        return None
    out = np.zeros(len(y), bool)
    for c in (0, 1):  # a fifth of each class
        own = np.flatnonzero(y == c)
        out[own[::5]] = True
    pick = lambda x, keep: [x[i] for i in np.flatnonzero(keep)]
    use = telling(pick(feature, ~out), y[~out])
    scale = use * np.concatenate([np.full(1 << WORD_BITS, WORD_SCALE[head]), np.ones(1 << GRAM_BITS)])
    value = [scale[f] * v for f, v in zip(feature, value)]
    w, b = fit(Rows(pick(feature, ~out), pick(value, ~out)), y[~out])
    w *= scale
    slope, shift = platt(Rows(pick(feature, out), pick(value, out)).times(np.divide(w, scale, out=np.zeros(FEATURES), where=use)) + b, y[out])
    return w, b, slope, shift


def fit_models(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Models of quality and toxicity, from a bounded sample; docs: id, text; labels: id, quality, toxic."""
    own = labels.where("id is not null").groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("id"))
    own = own.orderBy("order", "id").limit(fit_rows)
    joined = docs.join(F.broadcast(own), "id").select("id", "text", "order", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    joined = joined.groupBy("id", "order", "quality", "toxic").agg(F.min("text").alias("text")).select("id", "text", "order", "quality", "toxic")
    rows = joined.mapInArrow(lean(_features), "order bigint, quality int, toxic int, feature binary, value binary").orderBy("order").collect()
    out = {}
    for head in ("quality", "toxic"):
        use = [r for r in rows if r[head] is not None]
        y = np.array([int(r[head] == 1) for r in use])
        model = train(head, y, [np.frombuffer(r["feature"], "<u4") for r in use], [np.frombuffer(r["value"], "<f4") for r in use]) if use else None
        out[head] = None if model is None else (model[0].astype(np.float32), *model[1:])
    return out


def judge(data: np.ndarray, offsets: np.ndarray, models: dict, thresholds: tuple[float, float]):
    """Base counts, whether base rules fail, probabilities by model (nan without one), and the verdict on each text."""
    w, c = counts(data, offsets)
    failed = base_failed(c)
    n = len(failed)
    wd, wf = word_features(w)
    gf, gd, size = gram_features(data, offsets)
    p = {}
    for head, model in models.items():
        if model is None:
            p[head] = np.full(n, np.nan)
            continue
        weight, bias, slope, shift = model
        score = bias + np.bincount(wd, weight[wf], n) + GRAM_SCALE * np.bincount(gd, weight[gf], n) / np.maximum(1, size)
        p[head] = _sigmoid(slope * score + shift)
    return c, failed, p, ~failed & ~(p["quality"] < thresholds[0]) & ~(p["toxic"] >= thresholds[1])


def _score(models, thresholds: tuple[float, float]):
    def run(batches):
        for piece in slices(batches, JUDGE_BYTES):
            c, failed, p, kept = judge(*utf8(piece.column(1)), models.value, thresholds)
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            arrays = [id_array(ids_of(piece.column(0))), *(pa.array(c[k], pa.int64()) for k in names[1:6]), pa.array(failed), pa.array(kept)]
            arrays += [pa.array(p[h], pa.float64(), mask=np.isnan(p[h])) for h in ("quality", "toxic")]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _models(docs: DataFrame, labels: DataFrame, id_col, text_col, label_id_col, quality_col, toxic_col, fit_rows):
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    models = fit_models(own, labels.select(F.col(label_id_col).cast("bigint").alias("id"), F.col(quality_col).alias("quality"), F.col(toxic_col).alias("toxic")), fit_rows)
    return own, docs.sparkSession.sparkContext.broadcast(models)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic", fit_rows: int = FIT_ROWS, thresholds: tuple[float, float] = (THRESHOLD_QUALITY, THRESHOLD_TOXIC)) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, p_quality, p_toxic (null without a model).

    kept: the base rules hold, p_quality is at least and p_toxic below its threshold."""
    own, models = _models(docs, labels, id_col, text_col, label_id_col, quality_col, toxic_col, fit_rows)
    return own.mapInArrow(lean(_score(models, thresholds)), SCHEMA)


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic", fit_rows: int = FIT_ROWS, thresholds: tuple[float, float] = (THRESHOLD_QUALITY, THRESHOLD_TOXIC)) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    _, models = _models(docs, labels, id_col, text_col, label_id_col, quality_col, toxic_col, fit_rows)
    return row_filter(docs, text_col, lambda: lambda data, offsets: judge(data, offsets, models.value, thresholds)[3], JUDGE_BYTES)

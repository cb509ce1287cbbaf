"""LM scoring (operator 2): a hierarchical Pitman-Yor model of word pairs.

Each context (the word before, or a text's start) is a restaurant; all
contexts share one parent restaurant, whose base is uniform over the known words
and one unknown.  Customers of a context are its training tokens, customers of the
parent are the contexts' tables.  Seatings are sampled by Gibbs:

1. tokens are numbered: words meet by buckets of their hashes, get their
   training counts and numbers, and go back to their chunks;
2. distinct (context, word) pairs of each chunk, with training counts, go to
   buckets of the context, and are written there, so that they are exchanged once.  Contexts that hold more than a bucket's share of the
   corpus are dealt by context and word; their totals are known from step 1, their tables from step 3;
3. the contexts' seatings are sampled, first with the bucket's own tables for the parent's, and their tables go to buckets of
   words, where the parent's seating is sampled and split contexts' tables are summed;
4. the parent's probabilities come back and the contexts' seatings are sampled
   again; 3 and this are done `exchanges` times in all, so that with more than one the parent is
   sampled again, too.  The last time the contexts are sampled `sweeps` times, and their
   predictive probabilities are averaged without the first `burn_in`;
5. each pair's probability goes back to its chunks, where texts are summed.

A sweep draws the tables of all pairs from their distribution given the parent and what a
new table of the context weighs, which is drawn first, given the context's tables (a gamma
variable, with which its dishes are independent).  It is exact to `EXACT_SEATS` customers
of one pair; beyond, the number of tables has the mean and variance of a saddle point (within 3 % in tests).
The parent's probabilities are their means given its seating.  Seeds are fixed, so reruns agree.

Texts whose crc32(id as text) modulo `folds` is `held` are scored but not
learned from.  A null text is empty: its one token is the end.  A very long text is a chunk by itself.  A null id counts as
the empty text.  Rows that repeat an id are texts of their own.  Without
training tokens all probabilities are those of the uniform base.  An empty table
gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, NULL_ID, SPACE, Words, blob, bucket_count, by_bucket, dealt, id_array, ids_of, mix, ship, slices, text_bytes, utf8, written

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
END = U64(0x9D3F5C0B7A6E1D25)
DISCOUNTS, STRENGTH = (0.7, 0.6), 1.0
SWEEPS, BURN_IN, EXACT_SEATS, EXCHANGES = 16, 4, 64, 2
#: Sweeps before an exchange, and of the parent.
FIRST, PARENT = 4, 8
#: log10 probabilities travel in steps of this.
STEP = 2.0**-19
CHUNK_TOKENS = 2_000_000

TOKENS = "chunk bigint, ids array<bigint>, counts binary, tokens binary, words binary"
SENT = "bucket bigint, chunk bigint, a binary, b binary, c binary"
BACK = "chunk bigint, kind int, bucket bigint, a binary, b binary"
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def squeeze(x: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T) if len(x) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(x: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def held_out(ids: np.ndarray, folds: int, held: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i == NULL_ID else str(i).encode()) % folds == held for i in ids.tolist()), bool, len(ids))


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and how many each text has."""
    w = Words(LOWER[data], offsets, ~SPACE)
    h = w.hashes()
    return np.insert(h, w.first[1:], END), w.count + 1


def _tokenise(limit: int):
    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row():
            ids, hashes, counts = (np.concatenate([x[i] for x in held]) for i in range(3))
            words, tokens = np.unique(hashes, return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([id_array(ids).to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (squeeze(counts.astype("<u8")), squeeze(tokens.astype("<u4")), blob(words)))],
                names=["chunk", "ids", "counts", "tokens", "words"],
            )

        for piece in slices(batches, CHUNK_BYTES):
            hashes, counts = token_hashes(*utf8(piece.column(1)))
            if held and size + len(hashes) > limit:
                yield row()
                number, held, size = number + 1, [], 0
            held.append((ids_of(piece.column(0)), hashes, counts))
            size += len(hashes)
        if held:
            yield row()

    return run


class Chunk:
    def __init__(self, table, folds: int, held: int, i: int = 0):
        get = lambda c: table.column(c)[i].as_py()
        self.number = get("chunk")
        self.ids = np.array([NULL_ID if x is None else x for x in get("ids")], np.int64)
        self.counts, self.tokens = expand(get("counts"), "<u8").astype(np.int64), expand(get("tokens"), "<u4")
        self.words = np.frombuffer(get("words"), "<u8")
        self.held = held_out(self.ids, folds, held)
        self.train = np.repeat(~self.held, self.counts)

    def deal(self, buckets: int):
        """Words by bucket: their order, and where each bucket lies in it."""
        bucket = ((self.words >> U64(20)) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, by_bucket(bucket[order])

    def numbered(self, answers: dict[int, tuple[bytes, bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and training counts of the chunk's words."""
        number, count = np.empty(len(self.words), np.int64), np.empty(len(self.words), np.int64)
        order, parts = self.deal(buckets)
        for bucket, p in parts:
            number[order[p]] = expand(answers[bucket][0], "<i8")
            count[order[p]] = expand(answers[bucket][1], "<i8")
        return number, count

    def pairs(self, number: np.ndarray, buckets: int, hot: np.ndarray):
        """Distinct (context, word) pairs by bucket; which pair each token is; training counts; the buckets' places."""
        word = number[self.tokens]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        ends = np.cumsum(self.counts)
        context[np.concatenate([[0], ends[:-1]])] = -1
        own, which = np.unique(self.tokens, return_inverse=True)
        before = np.empty(len(which), np.int64)
        before[1:] = which[:-1]
        before[np.concatenate([[0], ends[:-1]])] = len(own)
        _, first, pair = np.unique(before * (len(own) + 1) + which, return_index=True, return_inverse=True)
        u, w = context[first], word[first]
        count = np.bincount(pair, self.train, len(first)).astype(np.int64)
        key = mix(u.astype(U64) + U64(1))
        split = np.isin(u, hot)
        key[split] ^= mix(w[split].astype(U64) + U64(77))
        bucket = (key % U64(buckets)).astype(np.int64)
        order = np.lexsort((w, u, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return u[order], w[order], count[order], place[pair], by_bucket(bucket[order])


def table_of(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _send_words(buckets: int, folds: int, held: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch, folds, held, i)
                count = np.bincount(c.tokens, c.train, len(c.words)).astype("<i8")
                order, parts = c.deal(buckets)
                yield from table_of(SENT, [(b, c.number, blob(c.words[order[p]]), squeeze(count[order[p]]), None) for b, p in parts]).to_batches()

    return run


def _number_words(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        words = [np.frombuffer(x, "<u8") for x in table.column("a").to_pylist()]
        own, which = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(which, np.concatenate([expand(x, "<i8") for x in table.column("b").to_pylist()]), len(own)).astype("<i8")
        order = np.argsort(-count, kind="stable")
        number = np.empty(len(own), "<i8")
        number[order] = np.arange(len(own)) * buckets + bucket  # frequent words get small numbers, which pack well
        out, at = [], 0
        for chunk, x in zip(table.column("chunk").to_pylist(), words):
            k = which[at : at + len(x)]
            out.append((chunk, 0, bucket, squeeze(number[k]), squeeze(count[k])))
            at += len(x)
        top = order[:64]
        out.append((-1, 1, bucket, blob(np.array([count.sum(), np.count_nonzero(count)], "<i8")), blob(np.stack([number[top], count[top]]).astype("<i8"))))
        return table_of(BACK, out)

    return run


def _by_bucket(answered: pa.Table, kind: int) -> dict[int, tuple[bytes, bytes]]:
    return {b: (x, y) for k, b, x, y in zip(*(answered.column(c).to_pylist() for c in ("kind", "bucket", "a", "b"))) if k == kind}


def _send_pairs(buckets: int, folds: int, held: int, hot: np.ndarray):
    def run(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return table_of(SENT, [])
        c = Chunk(chunk, folds, held)
        number, _ = c.numbered(_by_bucket(answered, 0), buckets)
        u, w, count, _, parts = c.pairs(number, buckets, hot)
        return table_of(SENT, [(b, c.number, squeeze(np.diff(u[p], prepend=0)), squeeze(w[p]), squeeze(count[p])) for b, p in parts])

    return run


class Pairs:
    """All distinct pairs of a bucket, and the restaurants they are in."""

    def __init__(self, table: pa.Table, hot: dict[int, int], tables: dict[int, int] | None = None):
        self.chunks = table.column("chunk").to_pylist()
        us = [np.cumsum(expand(x, "<i8")) for x in table.column("a").to_pylist()]
        ws = [expand(x, "<i8") for x in table.column("b").to_pylist()]
        self.sizes = [len(x) for x in us]
        u, w = np.concatenate(us), np.concatenate(ws)
        count = np.concatenate([expand(x, "<i8") for x in table.column("c").to_pylist()])
        del us, ws
        if len(u) and max(int(u.max()), int(w.max())) < 2**31 - 1:  # runs of pairs in order, which merge
            key = (u + 1) << 32 | w
            order = np.argsort(key, kind="stable")
            del key
        else:
            order = np.lexsort((w, u))
        u, w = u[order], w[order]
        new = np.ones(len(order), bool)
        new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        self.which = np.empty(len(order), np.int32 if len(order) < 2**31 else np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.u, self.w = u[new], w[new]
        del order, u, w, new
        self.c = np.bincount(self.which, count, len(self.u)).astype(np.int64)
        self.words, self.word = np.unique(self.w, return_inverse=True)
        names, self.room = np.unique(self.u, return_inverse=True)
        self.own = np.bincount(self.room, self.c, len(names))  # customers here
        self.total = self.own.copy()
        for i in np.flatnonzero(np.isin(names, list(hot))) if hot else ():
            self.total[i] = hot[int(names[i])]
        self.names, self.split = names, np.isin(names, list(hot)) if hot else np.zeros(len(names), bool)
        self.scale = np.divide(self.total, self.own, out=np.ones(len(names)), where=self.own > 0)  # a split context's tables elsewhere, before they are summed
        self.summed = None if tables is None else np.array([tables.get(int(n), 0) for n in names[self.split]], float)
        self.t, self.groups = (self.c > 0).astype(np.int64), by_count(self.c)

    def sweep(self, up: np.ndarray, rng: np.random.Generator) -> None:
        """All tables again, given the parent's probabilities of the pairs' words."""
        self.t = reseat(self.c, new_table(self.tables(), DISCOUNTS[0], rng)[self.room] * up, DISCOUNTS[0], rng, self.groups)

    def tables(self) -> np.ndarray:
        """Tables of each restaurant."""
        out = np.bincount(self.room, self.t, len(self.total)) * self.scale
        if self.summed is not None:
            out[self.split] = self.summed
        return out


def seat(c: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers who sit down one by one, to begin with; `fresh`: weight of a new table, (strength + discount * tables) * parent's probability.

    Each sits down without regard to those who come later, which gives too many tables; reseat() draws from their distribution."""
    t = (c > 0).astype(np.int64)
    go = np.flatnonzero(c > 1)
    n = 1
    while len(go):
        left = c[go] - n
        if n < EXACT_SEATS:
            block = 1
            new = rng.random(len(go)) * (fresh[go] + n - discount * t[go]) < fresh[go]
            t[go] += new
            n += 1
        else:
            block = np.minimum(left, n // 4)
            p = fresh[go] / (fresh[go] + n + block / 2 - discount * t[go])
            t[go] += rng.binomial(block, np.clip(p, 0, 1))
            n += n // 4
        go = go[c[go] > n]
    return t


def log_stirling(discount: float, n: int = EXACT_SEATS) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: of c customers' seatings at t tables, by [c, t]."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0
    for c in range(n):
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - discount * np.arange(1, n + 1), 1e-300)))
    return out


def by_count(c: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Rows of each count from 2 to EXACT_SEATS, and at EXACT_SEATS + 1 all rows beyond."""
    order = np.argsort(np.minimum(c, EXACT_SEATS + 1), kind="stable")
    return [(n, order[p]) for n, p in by_bucket(np.minimum(c, EXACT_SEATS + 1)[order]) if n > 1]


def _exact(n: int, log_new: np.ndarray, numbers: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with n customers each, from their distribution."""
    w = log_new[:, None] * np.arange(1, n + 1) + numbers[n, 1 : n + 1]
    w -= w.max(axis=1, keepdims=True)
    w = np.cumsum(np.exp(w, out=w), axis=1, out=w)
    return 1 + (w < rng.random(len(w))[:, None] * w[:, -1:]).sum(axis=1)


def _many(c: np.ndarray, f: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with many customers: a binomial number after the first, with the mean and variance of the saddle
    point of exp(f * (1 - (1 - z)**discount) / discount), whose coefficients are the sums of the weights."""
    low, high = np.minimum(0, np.log(f / c)) / (1 - discount) - 1, np.full(len(f), 40.0)
    for _ in range(50):  # y = 1 - z, where f * z * y**(discount - 1) = c, by its logit
        x = (low + high) / 2
        far = np.log(f / c) - np.logaddexp(0, x) + (1 - discount) * np.logaddexp(0, -x) < 0
        low, high = np.where(far, low, x), np.where(far, x, high)
    y = 1 / (1 + np.exp(-low))
    after = f * (1 - y**discount) / discount
    spread = c * y / (y + (1 - discount) * (1 - y))  # by which the variance is less than the mean
    mean = np.maximum(after - 1 + (1 - y) ** 2, 1e-9)
    tries = np.clip(np.rint(mean**2 / np.maximum(spread, 1e-12)), np.ceil(mean), 1e15)
    return 1 + np.minimum(c - 1, rng.binomial(np.maximum(tries, 1).astype(np.int64), np.minimum(1, mean / np.maximum(tries, 1))))


def reseat(c: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator, groups: list | None = None) -> np.ndarray:
    """Tables of dishes with c customers, t with weight S(c, t) * new**t: all seatings, given what a new table weighs.

    Exact to EXACT_SEATS customers, by mean and variance beyond."""
    t, numbers = (c > 0).astype(np.int64), NUMBERS[discount]
    for n, rows in by_count(c) if groups is None else groups:
        f = new[rows]
        if n == 2:
            t[rows] += rng.random(len(rows)) * (f + 1 - discount) < f
        elif n <= EXACT_SEATS:
            t[rows] = _exact(n, np.log(f), numbers, rng)
        else:
            t[rows] = _many(c[rows], f, discount, rng)
    return t


NUMBERS = {d: log_stirling(d) for d in DISCOUNTS}


def new_table(tables: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """What a new table weighs but for its dish, drawn given the tables: with it, a restaurant's dishes are independent of each other."""
    return discount * rng.standard_gamma(STRENGTH / discount + tables)


def _tables(x: Pairs, bucket: int, buckets: int) -> pa.Table:
    """The tables of each word, and those of split contexts, to the buckets of words."""
    tables = np.bincount(x.word, x.t, len(x.words)).astype("<i8")
    to = x.words % buckets
    order = np.argsort(to, kind="stable")
    parts, split = dict(by_bucket(to[order])), np.flatnonzero(x.split)
    here, goes = np.bincount(x.room, x.t, len(x.names)), x.names[split] % buckets
    out = []
    for b in sorted({*parts, *goes.tolist()}):
        p, own = order[parts.get(b, slice(0, 0))], split[goes == b]
        out.append((b, bucket, squeeze(np.diff(x.words[p], prepend=0)), squeeze(tables[p]), blob(np.stack([x.names[own], here[own]]).astype("<i8"))))
    return table_of(SENT, out)


def _first_tables(buckets: int, hot: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        x = Pairs(table, hot)
        share = (np.bincount(x.word, x.c, len(x.words)) + 1.0) / (x.c.sum() + len(x.words) + 1.0)
        rng = np.random.default_rng([11, bucket])
        x.t = seat(x.c, (STRENGTH + DISCOUNTS[0] * x.tables()[x.room]) * share[x.word], DISCOUNTS[0], rng)
        for _ in range(FIRST):  # the bucket's own tables stand for the parent's customers
            share = (np.bincount(x.word, x.t, len(x.words)) + 1.0) / (x.t.sum() + len(x.words) + 1.0)
            x.sweep(share[x.word], rng)
        return _tables(x, bucket, buckets)

    return run


def _next_tables(buckets: int, hot: dict[int, int], hot_tables: dict[int, int], vocabulary: int, turn: int):
    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table_of(SENT, [])
        bucket = table.column("bucket")[0].as_py()
        x = Pairs(table, hot, hot_tables)
        up = _parent(x, answered, buckets, vocabulary)
        rng = np.random.default_rng([19, bucket, turn])
        for _ in range(FIRST):
            x.sweep(up, rng)
        return _tables(x, bucket, buckets)

    return run


def _seat_parent(buckets: int, vocabulary: int):
    """The parent's customers and tables of each word, back to the buckets that asked; the sums of both, and of the tables of split contexts."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        words = [np.cumsum(expand(x, "<i8")) for x in table.column("a").to_pylist()]
        own, which = np.unique(np.concatenate(words), return_inverse=True)
        c = np.bincount(which, np.concatenate([expand(x, "<i8") for x in table.column("b").to_pylist()]), len(own)).astype("<i8")
        rng, t = np.random.default_rng([13, bucket]), (c > 0).astype(np.int64)
        groups = by_count(c)
        for _ in range(PARENT):
            t = reseat(c, np.full(len(c), new_table(t.sum() * buckets, DISCOUNTS[1], rng) / (vocabulary + 1)), DISCOUNTS[1], rng, groups)
        split, here = np.concatenate([np.frombuffer(x, "<i8").reshape(2, -1) for x in table.column("c").to_pylist()], axis=1)
        split, which_split = np.unique(split, return_inverse=True)
        out, at = [(-1, 1, bucket, blob(np.array([c.sum(), t.sum()], "<i8")), blob(np.stack([split, np.bincount(which_split, here, len(split))]).astype("<i8")))], 0
        for chunk, x in zip(table.column("chunk").to_pylist(), words):
            if not len(x):
                continue
            k = which[at : at + len(x)]
            out.append((chunk, 2, bucket, squeeze(c[k].astype("<i8")), squeeze(t[k].astype("<i8"))))
            at += len(x)
        return table_of(BACK, out)

    return run


def parent_probability(c: np.ndarray, t: np.ndarray, customers: float, tables: float, vocabulary: int) -> np.ndarray:
    d = DISCOUNTS[1]
    return (c - d * t + (STRENGTH + d * tables) / (vocabulary + 1)) / (STRENGTH + customers)


def _parent(x: Pairs, answered: pa.Table, buckets: int, vocabulary: int) -> np.ndarray:
    """The parent's probability of each pair's word, from the answers of the buckets of words."""
    c, t = np.zeros(len(x.words)), np.zeros(len(x.words))
    to = x.words % buckets
    order = np.argsort(to, kind="stable")
    places = dict(by_bucket(to[order]))
    for b, own, tables in zip(*(answered.column(k).to_pylist() for k in ("word_bucket", "a", "b"))):
        c[order[places[b]]], t[order[places[b]]] = expand(own, "<i8"), expand(tables, "<i8")
    return parent_probability(c, t, answered.column("customers")[0].as_py(), answered.column("tables")[0].as_py(), vocabulary)[x.word]


def _predict(buckets: int, hot: dict[int, int], hot_tables: dict[int, int], vocabulary: int, sweeps: int, burn_in: int):
    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table_of(BACK, [])
        bucket = table.column("bucket")[0].as_py()
        x = Pairs(table, hot, hot_tables)
        up = _parent(x, answered, buckets, vocabulary)
        rng, d = np.random.default_rng([17, bucket]), DISCOUNTS[0]
        p = np.zeros(len(x.c))
        for k in range(sweeps):
            x.sweep(up, rng)
            if k >= burn_in:
                p += (x.c - d * x.t + (STRENGTH + d * x.tables()[x.room]) * up) / (STRENGTH + x.total[x.room])
        steps = np.rint(-np.log10(np.maximum(p / max(1, sweeps - burn_in), 1e-300)) / STEP).astype("<u4")
        out, at = [], 0
        for chunk, n in zip(x.chunks, x.sizes):
            out.append((chunk, 3, bucket, squeeze(steps[x.which[at : at + n]]), None))
            at += n
        return table_of(BACK, out)

    return run


def _sum_texts(buckets: int, folds: int, held: int, hot: np.ndarray, n_train: int, vocabulary: int):
    def run(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not chunk.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        c = Chunk(chunk, folds, held)
        number, count = c.numbered(_by_bucket(answered, 0), buckets)
        _, _, _, pair, parts = c.pairs(number, buckets, hot)
        found = _by_bucket(answered, 3)
        steps = np.empty(parts[-1][1].stop, np.int64)
        for bucket, p in parts:
            steps[p] = expand(found[bucket][0], "<u4")
        ends = np.concatenate([[0], np.cumsum(c.counts)])
        summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
        per_word = count[c.tokens]
        base = np.add.reduceat(np.log10((per_word + 1) / (n_train + vocabulary + 1)), ends[:-1])
        values = [id_array(c.ids), c.held, c.counts, summed(per_word > 0), np.full(len(c.ids), n_train), base, -STEP * summed(steps[pair])]
        return pa.table([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, kinds)], names=names)

    return run


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN, exchanges: int = EXCHANGES, chunk_tokens: int = CHUNK_TOKENS, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    if exchanges < 1 or sweeps <= burn_in:
        raise ValueError("at least one exchange and one sweep after burn_in")
    spark = docs.sparkSession
    ship(spark)
    buckets = bucket_count(text_bytes(docs, text_col), bucket_bytes)
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    chunks = written(own.mapInArrow(_tokenise(chunk_tokens), TOKENS), "tokens")
    sent = chunks.mapInArrow(_send_words(buckets, folds, held), SENT)
    numbers = written(sent.groupBy("bucket").applyInArrow(_number_words(buckets), BACK), "numbers")
    sums = [(np.frombuffer(r.a, "<i8"), np.frombuffer(r.b, "<i8").reshape(2, -1)) for r in numbers.where("kind = 1").select("a", "b").toLocalIterator()]
    n_train, vocabulary = (int(sum(x[0][i] for x in sums)) for i in (0, 1))
    # contexts with more than a quarter of a bucket's share of the tokens
    hot = {int(i): int(n) for _, top in sums for i, n in top.T if n > n_train / (4 * buckets)}
    starts = docs.select(F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)).alias("f")).where(F.col("f") != held).count()
    if starts > n_train / (4 * buckets):
        hot[-1] = starts
    keys = np.array(sorted(hot), np.int64)
    known = numbers.where("kind = 0")
    pairs = dealt(chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_send_pairs(buckets, folds, held, keys), SENT), "bucket", min(2 * buckets, 10_000), "pairs")
    tables = pairs.groupBy("bucket").applyInArrow(_first_tables(buckets, hot), SENT)
    for turn in range(exchanges):
        seated = written(tables.groupBy("bucket").applyInArrow(_seat_parent(buckets, vocabulary), BACK), "parent")
        back = [(r.a, r.b) for r in seated.where("kind = 1").select("a", "b").toLocalIterator()]
        totals = [np.frombuffer(a, "<i8") for a, _ in back]
        hot_tables = {int(i): int(n) for _, b in back for i, n in np.frombuffer(b, "<i8").reshape(2, -1).T}
        customers, at_tables = (float(sum(x[i] for x in totals)) for i in (0, 1))
        replies = seated.where("kind = 2").select(F.col("chunk").alias("bucket"), F.col("bucket").alias("word_bucket"), "a", "b", F.lit(customers).alias("customers"), F.lit(at_tables).alias("tables"))
        if turn + 1 < exchanges:
            tables = pairs.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_next_tables(buckets, hot, hot_tables, vocabulary, turn), SENT)
    found = pairs.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_predict(buckets, hot, hot_tables, vocabulary, sweeps, burn_in), BACK)
    return chunks.groupBy("chunk").cogroup(known.unionByName(found).groupBy("chunk")).applyInArrow(_sum_texts(buckets, folds, held, keys, n_train, vocabulary), RESULT)

"""MinHash near-dedup (operator 8): ProbMinHash.

A document's weighted set has its shingles of five words (lower-cased; a text of
fewer words is one shingle), weighed by how often they occur.  Each shingle is a
Poisson process with its weight as rate; its arrivals, made from hashes, fall on
registers, and a register keeps its first arrival.  A process ends once it is
later than all registers of the document.  Equal registers estimate the
probability Jaccard similarity.  A second signature, of the same shingles with
weights of 1, estimates the Jaccard similarity of distinct shingles; where no
shingle repeats, it is the first one.  Registers of both are banded, and documents
that share a band are candidates:

1. equal texts are one node; node signatures are written once;
2. in each band bucket every node is paired with the bucket's least node (a
   star: as many pairs as rows), and pairs are verified on their whole sets;
3. connected components of the verified links;
4. buckets that still hold several components are compared across components in
   blocks of nodes, by signatures and then on whole sets, all within a task that
   returns only links that join components; and components are made again.  So every pair that shares a band is either in one component
   or has been compared.

A link is a probability Jaccard similarity of weighted shingles, or a Jaccard
similarity of distinct ones, of at least `threshold`.  For the comparison, sets are made
again for the nodes in pairs only, found by a Bloom filter of fixed size.

A very long text is a slice by itself, and its whole set is compared.
Texts without words (also null) have no similarity: each is a class of its own.
Null ids are in classes, but name one only if all its ids are null.  Rows that repeat an id and a text are copies.
An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, NULL_ID, SPACE, Words, join_hot, lean, lean_group, mix, ordered_spans, shared_dir, ship, slices, utf8, windows, written
from .url_filters import components

U64 = np.uint64
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
#: Nodes of a block in step 4, and the estimate from which a pair is compared whole (over 4 deviations below a similarity of 0.8).
BLOCK, ESTIMATE = 512, 0.65
#: Single comparisons of a node that may fail before its near pairs are compared in blocks.
TRIES = 8
BLOOM_WORDS = 1 << 19
GOLDEN = 0x9E3779B97F4A7C15

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and weight of each distinct shingle, by document and hash."""
    w = Words(LOWER[data], offsets, ~SPACE)
    each = w.hashes()
    long_ = np.repeat(w.count, w.count) >= width
    at = np.flatnonzero(long_ & (w.position() + width <= np.repeat(w.count, w.count)))
    h = windows(each, width)[at] if len(at) else np.zeros(0, U64)
    doc = w.doc()[at]
    short = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(short):
        whole = ordered_spans(np.arange(len(each)), w.first[short], w.first[short + 1], table=each)
        h = np.concatenate([h, mix(whole + U64(1))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """ProbMinHash registers (uint32) of each document; documents without shingles keep zeros."""
    full = np.iinfo(np.uint64).max
    reg = np.full(docs * registers, full, U64)
    rate, past, number = weight.astype(np.float64), np.zeros(len(h)), 0
    low = h & U64(0xFFFFFFFF)
    while len(h):
        many = 1 if len(h) > 60_000 else 16
        turn = (np.arange(number + 1, number + many + 1, dtype=np.uint64) * U64(GOLDEN))[None, :]
        x = mix(h[:, None] + turn)
        gap = -np.log(((x >> U64(40)).astype(np.float64) + 0.5) * 2.0**-24) / rate[:, None]
        time = past[:, None] + np.cumsum(gap, axis=1)
        packed = (time.astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | low[:, None]
        place = doc[:, None] * registers + (x & U64(0xFFFFFF)).astype(np.int64) % registers
        np.minimum.at(reg, place.ravel(), packed.ravel())
        number += many
        past = time[:, -1]
        latest = (reg.reshape(docs, registers).max(axis=1) >> U64(32)).astype(np.uint32)
        go = past.astype(np.float32).view(np.uint32) <= latest[doc]
        doc, h, rate, past, low = doc[go], h[go], rate[go], past[go], low[go]
    out = (reg & U64(0xFFFFFFFF)).astype(np.uint32)
    out[reg == full] = 0
    return out.reshape(docs, registers)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), U64)
    for b in range(bands):
        x = np.full(len(sig), (b + 1) * 0x2545F4914F6CDD1D % 2**64, U64)
        for r in range(rows):
            x = mix(x ^ (sig[:, b * rows + r].astype(U64) + U64(r)))
        out[:, b] = x
    return out.view(np.int64)


def _sign(width: int, bands: int, rows: int):
    def run(batches):
        for piece in slices(batches, CHUNK_BYTES):
            data, offsets = utf8(piece.column(1))
            n = len(offsets) - 1
            doc, h, weight = weighted_shingles(data, offsets, width)
            sig = signatures(doc, h, weight, n, bands * rows)
            keys = list(band_keys(sig, bands, rows))
            # a text that repeats shingles has a second signature, of distinct ones
            flat: list[bytes | None] = [None] * n
            again = np.bincount(doc, weight > 1, n) > 0
            if again.any():
                own, at = again[doc], np.flatnonzero(again)
                second = signatures((np.cumsum(again) - 1)[doc[own]], h[own], np.ones(own.sum(), np.int64), len(at), bands * rows)
                for i, x, k in zip(at, second, band_keys(second, bands, rows)):
                    flat[i], keys[i] = x.tobytes(), np.unique(np.concatenate([keys[i], k]))
            some = np.bincount(doc, minlength=n) > 0
            use = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(use)), pa.array([sig[i].tobytes() for i in use], pa.binary()), pa.array([flat[i] for i in use], pa.binary()), pa.array([keys[i] for i in use], pa.list_(pa.int64()))],
                names=["node", "sig", "flat", "bands"],
            )

    return run


def node_of(text: Column) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def _node_bits(nodes: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(nodes), "<u8").reshape(-1, 2)
    return np.stack([x[:, 0], x[:, 1]]) % U64(BLOOM_WORDS * 64)


def _bloom_rows(batches):
    for b in batches:
        at = _node_bits(b.column(0).to_pylist()).ravel()
        yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int64)), pa.array((U64(1) << (at & U64(63))).view(np.int64))], names=["word", "mask"])


def bloom(nodes: DataFrame) -> np.ndarray:
    """A filter of fixed size over the nodes; it only saves work, however full it is."""
    rows = nodes.select("node").mapInArrow(_bloom_rows, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(BLOOM_WORDS, U64)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(U64)
    return out


def _sets(width: int, wanted):
    def run(batches):
        words = wanted.value
        for batch in batches:
            at = _node_bits(batch.column(0).to_pylist()) if batch.num_rows else np.zeros((2, 0), U64)
            hit = ((words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)).all(axis=0)
            for piece in slices([batch.filter(pa.array(hit))], CHUNK_BYTES):
                data, offsets = utf8(piece.column(1))
                doc, h, weight = weighted_shingles(data, offsets, width)
                ends = np.searchsorted(doc, np.arange(len(offsets)))
                key = (h >> U64(32)).astype("<u4")
                spread = [(key[a:b].tobytes(), b"" if (weight[a:b] == 1).all() else weight[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([x for x, _ in spread], pa.binary()), pa.array([x for _, x in spread], pa.binary())], names=["node", "keys", "weights"])

    return run


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """The larger of probability Jaccard of the weights x, y of a, b (sorted, distinct) and Jaccard of a, b.

    Where neither can reach `least`, the second one is enough: probability Jaccard is at most the sum of the
    smaller shares."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = b[at] == a
    n = int(np.count_nonzero(hit))
    if not n:
        return 0.0
    plain, all_x, all_y = n / (len(a) + len(b) - n), float(x.sum(dtype=np.uint64)), float(y.sum(dtype=np.uint64))
    if all_x == len(a) and all_y == len(b):
        return plain
    cx, cy = x[hit].astype(float), y[at[hit]].astype(float)
    if max(plain, np.minimum(cx / all_x, cy / all_y).sum()) < least - 1e-9:
        return plain
    only_x, only_y, total = all_x - cx.sum(), all_y - cy.sum(), 0.0
    pairs, times = np.unique(x[hit].astype(U64) << U64(32) | y[at[hit]].astype(U64), return_counts=True)
    for pair, t in zip(pairs.tolist(), times.tolist()):
        px, py = pair >> 32, pair & 0xFFFFFFFF
        total += t / (only_x / px + only_y / py + np.maximum(cx / px, cy / py).sum())
    return max(plain, total)


def _compare(threshold: float):
    def run(batches):
        for b in batches:
            good, sims = [], []
            for i, (ka, wa, kb, wb) in enumerate(zip(*(b.column(c).to_pylist() for c in ("ka", "wa", "kb", "wb")))):
                a, c = np.frombuffer(ka, "<u4"), np.frombuffer(kb, "<u4")
                x = np.frombuffer(wa, "<u4") if wa else np.ones(len(a), np.uint32)
                y = np.frombuffer(wb, "<u4") if wb else np.ones(len(c), np.uint32)
                s = similarity(a, x, c, y, threshold)
                if s >= threshold:
                    good.append(i)
                    sims.append(s)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return run


def sets_of(nodes: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """Shingle sets of the nodes (and of few others): node, keys, weights."""
    wanted = own.sparkSession.sparkContext.broadcast(bloom(nodes))
    return own.mapInArrow(lean(_sets(width, wanted)), "node binary, keys binary, weights binary").groupBy("node").agg(F.first("keys").alias("keys"), F.first("weights").alias("weights"))


def verified(pairs: DataFrame, own: DataFrame, width: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are links, with their similarity; a written table."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), own, width)
    first = sets.select(F.col("node").alias("a"), F.col("keys").alias("ka"), F.col("weights").alias("wa"))
    second = sets.select(F.col("node").alias("b"), F.col("keys").alias("kb"), F.col("weights").alias("wb"))
    return written(pairs.join(second, "b").join(first, "a").select("a", "b", "ka", "wa", "kb", "wb").mapInArrow(lean(_compare(threshold)), "a binary, b binary, similarity double"), "links")


def bounds(sets: list[np.ndarray], weights: list[np.ndarray | None], columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of each two different sets, and what their probability Jaccard is at most.

    With U elements in two sets, an element's term is at most its larger weight over U."""
    n = len(sets)
    own, at = np.repeat(np.arange(n), [len(x) for x in sets]), np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([len(x) for x in sets], float)
    excess = np.array([0.0 if w is None else float(w.sum()) - len(w) for w in weights])
    shared = np.bincount(at)[at] > 1  # an element of one set alone only counts in its size
    own, at = own[shared], np.unique(at[shared], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    both, width = np.zeros((n, n), np.float32), int(at[-1]) + 1 if len(at) else 0
    for low in range(0, width, columns):
        a, b = np.searchsorted(at, [low, low + columns])
        has = np.zeros((n, min(columns, width - low)), np.float32)
        has[own[a:b], at[a:b] - low] = 1
        both += has @ has.T
    union = np.maximum(1, size[:, None] + size[None, :] - both)
    return both / union, (both + excess[:, None] + excess[None, :]) / union


def _across(estimate: float, threshold: float, rows: int):
    """Links that join the components in one pair of blocks of a bucket, of the pairs whose first shared band is this bucket's.

    Each node outside the largest component is tried on the nodes of other components that are nearest by
    either signature, until a link joins it or TRIES of them failed.  What near pairs are then left between
    components are compared whole, all of them."""

    def run(table: pa.Table) -> pa.Table:
        bi, bj, here = (table.column(c)[0].as_py() for c in ("bi", "bj", "key"))
        node, label, block, sig, flat, keys, weights = (table.column(c).to_pylist() for c in ("node", "label", "block", "sig", "flat", "keys", "weights"))
        flat = np.stack([np.frombuffer(x if y is None else y, np.uint32) for x, y in zip(sig, flat)])
        sig = np.stack([np.frombuffer(x, np.uint32) for x in sig])
        kinds = [sig] if (sig == flat).all() else [sig, flat]
        short = [np.ascontiguousarray((x ^ x >> 8 ^ x >> 16 ^ x >> 24).astype(np.uint8).T) for x in kinds]  # equal registers stay equal
        bands = [band_keys(x, sig.shape[1] // rows, rows) for x in kinds]
        band = next(int(np.flatnonzero(x[0] == here)[0]) for x in bands if (x[0] == here).any())
        part, block = np.unique(np.array(label, dtype=object), return_inverse=True)[1], np.array(block)
        top = np.arange(part.max() + 1)  # components as they are joined here
        out: list[tuple] = []

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        def shingles(k: int) -> tuple[np.ndarray, np.ndarray]:
            own = np.frombuffer(keys[k], "<u4")
            return own, np.frombuffer(weights[k], "<u4") if weights[k] else np.ones(len(own), np.uint32)

        def join(x: int, y: int, sim: float) -> bool:
            i, j = root(part[x]), root(part[y])
            if sim < threshold or i == j:
                return i == j
            top[i] = j
            out.append((*sorted((node[x], node[y])), sim))
            return True

        left = []
        for i in np.flatnonzero(part != np.bincount(part).argmax()).tolist():
            near = np.max([(x == x[:, i : i + 1]).view(np.uint8).sum(axis=0, dtype=np.uint32) for x in short], axis=0)
            other = (block[i] == bi) & (block == bj) | (block[i] == bj) & (block == bi)
            found = np.flatnonzero((near >= estimate * sig.shape[1]) & other & (part != part[i]))
            if band:  # a pair that shares an earlier band, too, is compared in that one's bucket
                found = found[~np.any([(x[i, :band] == y[found, :band]).any(axis=1) for x in bands for y in bands], axis=0)]
            failed = 0
            for k in found[np.argsort(-near[found], kind="stable")].tolist():
                if failed == TRIES:
                    left.append((i, found))
                    break
                if root(part[k]) != root(part[i]):
                    failed += not join(i, k, similarity(*shingles(i), *shingles(k), threshold))
        pairs = [(i, k) for i, found in left for k in found.tolist() if root(part[i]) != root(part[k])]
        if pairs:
            used, at = np.unique(np.array(pairs), return_inverse=True)
            sets = [shingles(k) for k in used]
            plain, most = bounds([x for x, _ in sets], [None if weights[k] == b"" or weights[k] is None else w for k, (_, w) in zip(used, sets)])
            for x, y in at.reshape(-1, 2).tolist():
                if most[x, y] >= threshold and root(part[used[x]]) != root(part[used[y]]):
                    join(used[x], used[y], float(plain[x, y]) if plain[x, y] >= threshold else similarity(*sets[x], *sets[y], threshold))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.float64()))], names=["a", "b", "similarity"])

    return run


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the nodes with links, and the links (a, b, similarity)."""
    spark = docs.sparkSession
    ship(spark)
    shared_dir(spark)
    text = F.col(text_col).cast("string")
    own = docs.where(F.length(text) > 0).select(node_of(text).alias("node"), text.alias("text"))
    signed = own.mapInArrow(lean(_sign(width, bands, rows)), "node binary, sig binary, flat binary, bands array<bigint>")
    signed = written(signed.groupBy("node").agg(F.first("sig").alias("sig"), F.first("flat").alias("flat"), F.first("bands").alias("bands")), "signatures")
    banded = signed.select("node", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(hubs, "key"), "members")
    pairs = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(pairs, own, width, threshold)
    label = components(links)
    # buckets that hold several components
    labelled = members.join(label, "node", "left").select("key", "node", "n", "hub", F.coalesce("component", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    left = written(labelled.join(mixed, "key").where("n > 2").select("key", "node", "n", "label"), "mixed")
    left = left.join(signed.select("node", "sig", "flat"), "node").join(sets_of(left.select("node").distinct(), own, width), "node")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    left = left.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("key", "node", "sig", "flat", "label", "keys", "weights", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    more = written(left.groupBy("key", "bi", "bj").applyInArrow(lean_group(_across(ESTIMATE, threshold, rows)), "a binary, b binary, similarity double"), "across")
    if more.limit(1).count():
        links = links.unionByName(more)
        label = components(links)
    return label, links


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, class_id (the least id of its class), class_size, kept (it is its class's first row), node."""
    label, _ = near_classes(docs, threshold, width, bands, rows, text_col)
    text = F.col(text_col).cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.when(worded, node_of(text)).alias("node"))
    own = own.join(label, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    classes = own.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "node")).alias("first"))
    out = join_hot(own, classes, "class", "class_size", docs.count())
    kept = F.col("class").isNull() | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.node") == F.col("node")))
    return out.select("doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"), kept.alias("kept"), "node")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """`docs` with one document of each class; of rows that repeat its id and text, one."""
    ident = lambda c: F.coalesce(c.cast("bigint"), F.lit(int(NULL_ID)))
    found = near_dedup(docs, id_col=id_col, text_col=text_col, **parameters).where("kept and node is not null").select(ident(F.col("doc_id")).alias("id"), "node").distinct()
    text = F.col(text_col).cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # whole rows travel as one column, whatever their columns are called
    some = docs.where(worded).select(ident(F.col(id_col)).alias("id"), node_of(text).alias("node"), F.struct(*docs.columns).alias("row"))
    kept = some.join(found, ["id", "node"], "left_semi").dropDuplicates(["id", "node"])
    return kept.select("row.*").unionByName(docs.where(~worded))

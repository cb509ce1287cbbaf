"""Benchmark decontamination (operator 4).

Benchmark items become windows of `n` normalised words (an item of fewer words
is one window).  A hash set of the windows is broadcast, after a check of its
size; a larger benchmark is taken in blocks, one broadcast after the other over
a written table.  Each document's words are hashed without loops, its windows
are looked up, and every hit is verified word by word.

A very long text is a slice by itself, hashed and looked up in blocks; equal windows of a slice are verified once.

Nulls are texts without words.  Rows with a null or repeated id are judged
each by itself.  An item without words is ignored; items that share an id are
one item; items without an id share the empty id.  Empty tables give no rows,
or rows without hits.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, covered, id_array, ids_of, lean, row_filter, ship, slices, utf8, windows, written

#: Bytes of benchmark text in one broadcast.
BLOCK_BYTES = 8 << 20

#: Fixed values of the contract: A-Z are lower-cased; digits, letters and all above ASCII are in words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = True
WORD[0x80:] = True

SCHEMA = "doc_id bigint, text string, n_words bigint, hit array<boolean>, items array<string>"


class Index:
    """Windows of benchmark items, by width: sorted hashes, and for each where its words are and its item.

    Some 24 bytes a window besides the items' words and a sieve, so a block of BLOCK_BYTES of text stays below five times that."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        texts = [(text or "").encode() for _, text in items]
        self.items = [item for item, _ in items]
        data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        w = Words(data, np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)]), WORD)
        body = data.tobytes()
        self.body = b" ".join([body[a:b] for a, b in zip(w.start, w.end)])
        begin = np.concatenate([[0], np.cumsum(w.end - w.start + 1)])
        hashes, item = w.hashes(), w.doc()
        width_of = np.minimum(w.count, n)
        self.widths: dict[int, tuple] = {}
        for width in np.unique(width_of[width_of > 0]).tolist():
            at = np.flatnonzero((width_of[item] == width) & (w.position() + width <= w.count[item]))
            h = windows(hashes, width)[at]
            order = np.lexsort((item[at], h))
            h, at = h[order], at[order]
            sieve = np.zeros(1 << 20, bool)
            sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.widths[width] = (h, sieve, begin[at], begin[at + width] - 1, item[at])

    def found(self, width: int, h: np.uint64, window: bytes) -> set[str]:
        """Items with this window."""
        known, _, begin, end, item = self.widths[width]
        low, high = np.searchsorted(known, h), np.searchsorted(known, h, "right")
        return {self.items[item[i]] for i in range(low, high) if self.body[begin[i] : end[i]] == window}

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, list[set[str]]]:
        """Words, which of them are hit, and the items found in each document."""
        data = LOWER[data]
        w = Words(data, offsets, WORD)
        items: list[set[str]] = [set() for _ in w.count]
        starts, ends = [], []
        if len(w):
            hashes, doc, room = w.hashes(), w.doc(), np.repeat(w.first[1:], w.count)
            for width, (known, sieve, *_) in self.widths.items():
                if len(w) < width:
                    continue
                h = windows(hashes, width)
                at = np.flatnonzero(sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                at = at[at + width <= room[at]]
                at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]
                good, seen = [], {}
                for i in at.tolist():
                    window = b" ".join([data[a:b].tobytes() for a, b in zip(w.start[i : i + width], w.end[i : i + width])])
                    own = seen.get(window)
                    if own is None:
                        seen[window] = own = self.found(width, h[i], window)
                    if own:
                        items[doc[i]] |= own
                        good.append(i)
                good = np.array(good, np.int64)
                starts.append(good)
                ends.append(good + width)
        if not starts:
            return w, np.zeros(len(w), bool), items
        return w, covered(len(w), np.concatenate(starts), np.concatenate(ends)), items


def _scanner(index):
    def run(batches):
        for piece in slices(batches, CHUNK_BYTES):
            data, offsets = utf8(piece.column(1))
            w, hit, items = index.value.scan(data, offsets)
            before = piece.column(3).to_pylist() if piece.num_columns > 3 else [None] * len(items)
            older = piece.column(4).to_pylist() if piece.num_columns > 3 else [None] * len(items)
            hits = []
            for i, seen in enumerate(before):
                own = hit[w.first[i] : w.first[i + 1]]
                own = own | np.array(seen, bool) if seen else own
                hits.append(own if own.any() else None)
            found = [sorted(x | set(y or ())) for x, y in zip(items, older)]
            yield pa.RecordBatch.from_arrays(
                [id_array(ids_of(piece.column(0))), piece.column(1).cast(pa.string()), pa.array(w.count, pa.int64()), pa.array(hits, pa.list_(pa.bool_())), pa.array(found, pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "hit", "items"],
            )

    return run


def benchmark_blocks(benchmark: DataFrame, n: int, item_col: str, text_col: str, block_bytes: int):
    """For each block of the benchmark a function that broadcasts its windows."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0").distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    for k in range(blocks):
        own = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield lambda own=own: spark.sparkContext.broadcast(Index([tuple(x) for x in own.collect()], n))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, text, n_words, hit (per word; null if none is), items (sorted ids as strings)."""
    ship(docs.sparkSession)
    blocks = list(benchmark_blocks(benchmark, n, item_col, item_text_col, block_bytes))
    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for k, index in enumerate(blocks):
        out = out.mapInArrow(lean(_scanner(index())), SCHEMA)
        if k < len(blocks) - 1:
            out = written(out, "hits")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, **columns) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = benchmark_hits(docs, benchmark, n, **columns)
    n_hit = F.coalesce(F.size(F.filter("hit", lambda x: x)), F.lit(0)).cast("bigint")
    n_hit = F.when(F.col("hit").isNull(), F.lit(0)).otherwise(n_hit).cast("bigint")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that no window hits, with all their columns."""
    ship(docs.sparkSession)

    def clean(index):
        def mask(data, offsets):
            w, hit, _ = index.value.scan(data, offsets)
            seen = np.concatenate([[0], np.cumsum(hit)])
            return seen[w.first[1:]] == seen[w.first[:-1]]

        return lambda: mask

    blocks = list(benchmark_blocks(benchmark, n, item_col, item_text_col, block_bytes))
    for k, index in enumerate(blocks):
        docs = row_filter(docs, text_col, clean(index()))
        if k < len(blocks) - 1:
            docs = written(docs, "clean")
    return docs


def _cut():
    def run(batches):
        for b in batches:
            texts, hits = b.column(1).to_pylist(), b.column(3).to_pylist()
            out = []
            for text, hit in zip(texts, hits):
                if hit and text:
                    data = text.encode()
                    low = LOWER[np.frombuffer(data, np.uint8)]
                    w = Words(low, np.array([0, len(low)]), WORD)
                    keep = np.ones(len(low), bool)
                    h = np.array(hit, bool)
                    edge = np.diff(np.concatenate([[0], h.astype(np.int8), [0]]))
                    for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1):
                        keep[w.start[a] : w.end[z]] = False
                    text = np.frombuffer(data, np.uint8)[keep].tobytes().decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(2), b.column(3), b.column(4)], names=["doc_id", "text", "n_words", "hit", "items"])

    return run


def cleaned(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", **columns) -> DataFrame:
    """doc_id and text of what is left: without the documents that are hit, or without the spans from first to last word of each hit."""
    hits = benchmark_hits(docs, benchmark, n, **columns)
    if remove == "documents":
        return hits.where("hit is null").select("doc_id", "text")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    return hits.mapInArrow(_cut(), SCHEMA).select("doc_id", "text")

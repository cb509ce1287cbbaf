"""Mixing sources to target weights (operator 5).

The words of each source are one stream, cut into blocks of `block_words`.
Every output shard has SHARD_SLOTS slots (the last one what is left) and draws
how many blocks it takes of each source: a multinomial over what is left of the
sources' quotas, so that the shards together take just the quotas.  A source's
slots are mapped to block numbers by a pseudorandom permutation of the source's
block numbers (a keyed Feistel network with cycle walking), one pass over a
source after the other, and a shard's blocks to its slots by another.  The
blocks' texts are joined to the slots: the mix is the rows of mixed_parts, and
what a document has in it is counted there.  A quota is at most three
passes, as a target is at most `most` times its source, so no document exceeds that either.

To number a source's words without one task that sees the whole source, its
documents are dealt by hash to segments of about `segment_words`; word positions
run within a segment, and a small table has each segment's first block.  A
segment's texts meet its slots in one task, so texts are exchanged once.  Shares
and quotas need one row per source on the driver, at most `max_sources`.

A very long text is cut into parts like any other, within its segment.  Sources that tie in name are one;
documents that tie in identifier are ordered by text, and equal ones have equal parts.

Null texts have no words.  The null source is a source, the last one.  Rows that
repeat an id are documents of their own.  Sources without words have target 0.
An empty table gives no rows.  Other columns are not looked at; mixed_parts carries them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SPACE, Words, lean, lean_pair, ship, utf8

#: Fixed values of the contract: words, and weights that repeat over the sources.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MAX_SOURCES = 100_000
SEGMENT_WORDS = 500_000
SHARD_SLOTS = 4_096


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of all words by weight, none over `most` times its size; the excess is shared again."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], total
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def quotas(target: list[float], sizes: list[int], blocks: list[int], most: int = 3) -> list[int]:
    """Blocks to take of each source."""
    return [min(most * n, round(t * n / s)) if s else 0 for t, s, n in zip(target, sizes, blocks)]


def shard_counts(quota: list[int], shard_slots: int, seed: int):
    """For each shard, how many slots each source has in it; yields (shard, counts, slots before)."""
    rng = np.random.default_rng(seed)
    left, before, shard = np.array(quota, np.int64), np.zeros(len(quota), np.int64), 0
    while left.sum() > 0:
        room = min(shard_slots, int(left.sum()))
        take = np.zeros(len(left), np.int64)
        while room:  # what a source hasn't left is drawn again
            draw = np.minimum(rng.multinomial(room, (left - take) / (left - take).sum()), left - take)
            take += draw
            room -= int(draw.sum())
        yield shard, take, before.copy()
        before += take
        left -= take
        shard += 1


def permute(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n), at the places `slot`."""
    half = max(1, (max(2, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    out = np.empty(len(slot), np.int64)
    todo, x = np.arange(len(slot)), slot.astype(np.uint64)
    while len(todo):
        left, right = x >> shift, x & low
        for turn in range(4):
            f = (right + np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & low)
        x = (left << shift) | right
        good = x < n
        out[todo[good]] = x[good]
        todo, x = todo[~good], x[~good]
    return out


DRAWS = "shard bigint, room bigint, base bigint, source_no bigint, first bigint, count bigint"
SLOTS = "source_no bigint, segment bigint, block bigint, shard bigint, slot bigint"


def _draws(quota: list[int], shard_slots: int, seed: int):
    """Rows of shards and sources: how many blocks, from which of the source's on, and the shard's blocks of sources before."""

    def run(batches):
        for b in batches:
            for _ in range(b.num_rows):
                for shard, take, start in shard_counts(quota, shard_slots, seed):
                    own, base = np.flatnonzero(take), np.cumsum(take) - take
                    columns = [np.full(len(own), shard), np.full(len(own), take.sum()), base[own], own, start[own], take[own]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in DRAWS.split(", ")])

    return run


def _slots(cut, seed: int):
    """A row per slot, with the block it takes; `cut`: sources and segments, in order, with their first blocks, and blocks of each source."""

    def run(batches):
        sources, segments, first, blocks = cut.value
        for b in batches:
            for shard, room, base, source_no, a, count in zip(*(b.column(c).to_pylist() for c in range(6))):
                n, place = int(blocks[source_no]), np.arange(a, a + count)
                turn = place // n
                block = np.concatenate([permute(place[turn == t] - t * n, n, seed * 1_000_003 + source_no * 31 + int(t)) for t in np.unique(turn)])
                low, high = np.searchsorted(sources, [source_no, source_no + 1])
                at = low + np.searchsorted(first[low:high], block, "right") - 1
                slot = permute(np.arange(base, base + count), room, seed * 7_000_003 + shard)
                columns = [np.full(count, source_no), segments[at], block - first[at], np.full(count, shard), slot]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in SLOTS.split(", ")])

    return run


def cut_parts(data: np.ndarray, offsets: np.ndarray, block_words: int):
    """Texts, one after the other, cut at block bounds: document, block, words and text of each part.

    A part goes up to the next part's first word, so a document's parts are its text."""
    w = Words(data, offsets, ~SPACE)
    doc, inside = w.doc(), w.position()
    start = np.flatnonzero((np.arange(len(w)) % block_words == 0) | (inside == 0))
    doc, opens = doc[start], inside[start] == 0
    begin = np.where(opens, offsets[doc], w.start[start])
    last = np.append(opens[1:], True)[: len(start)]
    end = np.where(last, offsets[doc + 1], np.append(begin[1:], 0)[: len(start)])
    body = data.tobytes()
    return w.count, doc, start // block_words, np.diff(np.append(start, len(w))), [body[a:b] for a, b in zip(begin, end)]


def _deal(block_words: int, names: list[str]):
    """Of a segment: a row for each document (shard is null) and one for each part of each slot."""

    def run(docs: pa.Table, slots: pa.Table) -> pa.Table:
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        size, doc, block, words, text = cut_parts(*utf8(docs.column("text")), block_words)
        slots = slots.sort_by([("shard", "ascending"), ("slot", "ascending")])
        own = slots.column("block").to_numpy()
        low, high = np.searchsorted(block, own), np.searchsorted(block, own, "right")
        which = np.repeat(np.arange(len(own)), high - low)
        place = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        part = low[which] + place
        n, row = docs.num_rows, np.concatenate([np.arange(docs.num_rows), doc[part]]).astype(np.int64)
        none = lambda kind: pa.nulls(n, kind)
        both = lambda x: pa.concat_arrays([none(pa.int64()), pa.array(x, pa.int64())])
        dealt = {
            "row": pa.array(row),
            "size": pa.array(size[row], pa.int64()),
            "shard": both(slots.column("shard").to_numpy()[which]),
            "slot": both(slots.column("slot").to_numpy()[which]),
            "place": both(place),
            "words": pa.array(np.concatenate([np.zeros(n, np.int64), words[part]]), pa.int64()),
            "part": pa.concat_arrays([none(pa.string()), pa.array(text, pa.string()).take(pa.array(part, pa.int64()))]),
        }
        kept = docs.select([x for x in names if x not in dealt]).take(pa.array(row))  # without the whole texts
        return pa.table([dealt[x] if x in dealt else kept.column(x) for x in names], names=names)

    return run


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _mixed(docs: DataFrame, weights, block_words: int, most: int, seed: int, id_col: str, text_col: str, source_col: str, max_sources: int, segment_words: int, shard_slots: int, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of _deal of all segments, and the sources: source, source_no, source_size, target."""
    spark = docs.sparkSession
    ship(spark)
    source = F.col(source_col).cast("string").alias("source")
    found = docs.select(source, word_count(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found = sorted(found, key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    names, sizes = [r.source for r in found], [int(r.n) for r in found]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    known = spark.createDataFrame([(x, i, n, t) for i, (x, n, t) in enumerate(zip(names, sizes, target))], "source string, source_no bigint, source_size bigint, target double")
    near = F.broadcast(known) if len(names) <= 10_000 else known
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), source, *([F.struct(*carry).alias("carried")] if carry else []))
    own = own.join(near, own["source"].eqNullSafe(known["source"])).drop("source")
    segments = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(segment_words))).cast("bigint")
    own = own.withColumn("segment", F.pmod(F.xxhash64("doc_id", "text"), segments)).drop("source_size", "target")
    # first block of each segment of a source
    cut = own.groupBy("source_no", "segment").agg(F.sum(word_count(F.col("text"))).alias("n")).toArrow().sort_by([("source_no", "ascending"), ("segment", "ascending")])
    of, segment, many = (cut.column(c).to_numpy().astype(np.int64) for c in ("source_no", "segment", "n"))
    many = -(-many // block_words)
    blocks = np.bincount(of, many, len(names)).astype(np.int64)
    first = np.cumsum(many) - many - (np.cumsum(blocks) - blocks)[of]
    places = spark.sparkContext.broadcast((of, segment, first, blocks))
    drawn = spark.range(0, 1, 1, 1).mapInArrow(_draws(quotas(target, sizes, blocks.tolist(), most), shard_slots, seed), DRAWS)
    slots = drawn.repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(lean(_slots(places, seed)), SLOTS)
    schema = StructType.fromDDL("source_no bigint, segment bigint, row bigint, doc_id bigint, size bigint, shard bigint, slot bigint, place bigint, words bigint, part string")
    if carry:
        schema = StructType([*schema.fields, own.schema["carried"]])
    dealt = own.groupBy("source_no", "segment").cogroup(slots.groupBy("source_no", "segment")).applyInArrow(lean_pair(_deal(block_words, schema.names)), schema)
    return dealt, near


def mixed_parts(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = 128, most: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = MAX_SOURCES, segment_words: int = SEGMENT_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix, a row for each document part of each slot: shard, slot, place (of the part in the slot's block), doc_id, source, words, text, carried (the document's other columns)."""
    dealt, known = _mixed(docs, weights, block_words, most, seed, id_col, text_col, source_col, max_sources, segment_words, shard_slots, [c for c in docs.columns if c != text_col])
    return dealt.where("shard is not null").join(known, "source_no").select("shard", "slot", "place", "doc_id", "source", "words", F.col("part").alias("text"), "carried")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = 128, most: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = MAX_SOURCES, segment_words: int = SEGMENT_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, taken (its words in the rows of mixed_parts)."""
    dealt, known = _mixed(docs, weights, block_words, most, seed, id_col, text_col, source_col, max_sources, segment_words, shard_slots, [])
    taken = dealt.groupBy("source_no", "segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum("words").alias("taken"))
    return taken.join(known, "source_no").select("doc_id", "size", "source", "source_size", "target", "taken")

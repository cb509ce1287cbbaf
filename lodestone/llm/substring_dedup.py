"""Substring dedup (operator 1): difference-cover anchors.

Two equal passages of `length` words start at any two places.  Hashes of
`anchor` words are taken only where a word's number modulo `period` lies in a
difference cover: for every pair of starts some shift below `period` brings
both to cover positions, so as length >= period + anchor - 1, any match shares
an aligned anchor.  Three passes over a written table of chunks:

1. anchors that occur more than once, by buckets of their hashes;
2. around such anchors, windows of `length` words are extended and compared
   with all their occurrences, again by buckets: 96-bit keys beyond the
   bucket number, and the first occurrence of each key wins;
3. words covered by a window that occurred earlier are removed.

Within a chunk each hash is sent once, so a passage that fills a third of the
corpus costs its bucket one entry per chunk.

Earlier means a smaller id, or the same id and an earlier start.  Null texts
have no words; a null id sorts before all others; rows with an equal id
count as the same document.  An empty table gives no rows.  Other columns are not looked at.  A very long text is
a chunk by itself.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BASE2, BUCKET_BYTES, CHUNK_BYTES, SPACE, Words, bits, blob, bucket_count, by_bucket, covered, id_array, mix, pack, text_bytes, unbits, unpack, windows

#: Perfect difference sets modulo their periods.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
U64 = np.uint64

SENT = "bucket bigint, chunk bigint, keys binary, checks binary, owners binary, starts binary"
BACK = "chunk bigint, bucket bigint, bits binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string, removed_spans array<struct<start:bigint,end:bigint>>"


def rows(columns: list[tuple[str, list, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array(v, t) for _, v, t in columns], names=[n for n, _, _ in columns])


def sent(bucket=(), chunk=(), keys=(), checks=(), owners=(), starts=()) -> pa.Table:
    none = [None] * len(bucket)
    return rows([("bucket", list(bucket), pa.int64()), ("chunk", list(chunk), pa.int64())] + [(n, list(v) or none, pa.binary()) for n, v in (("keys", keys), ("checks", checks), ("owners", owners), ("starts", starts))])


def back(found: list[tuple[int, int, bytes]]) -> pa.Table:
    return rows([("chunk", [x[0] for x in found], pa.int64()), ("bucket", [x[1] for x in found], pa.int64()), ("bits", [x[2] for x in found], pa.binary())])


class Plan:
    """Parameters of one run, and what each pass works out of a chunk."""

    def __init__(self, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.period = max((p for p in COVERS if p <= max(3, 2 * length // 3)), default=3)
        if length < 4:
            raise ValueError("passages of fewer than 4 words have no cover")
        self.anchor = length - self.period + 1
        self.cover = np.zeros(self.period, bool)
        self.cover[list(COVERS[self.period])] = True

    def words(self, chunk: pa.Table):
        number, ids, data, offsets = unpack(chunk)
        w = Words(data, offsets, ~SPACE)
        return number, ids, w

    def anchors(self, w: Words):
        """Cover positions with room for an anchor; the sorted distinct (bucket, key) pairs; each anchor's pair; how often each occurs."""
        hashes, position = w.hashes(), w.position()
        at = np.flatnonzero(self.cover[position % self.period] & (position + self.anchor <= np.repeat(w.count, w.count)))
        h = windows(hashes, self.anchor)[at] if len(at) else np.zeros(0, U64)
        pair = ((h >> U64(40)) % U64(self.buckets)) << U64(32) | (h & U64(0xFFFFFFFF))
        known, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        return hashes, at, known, which, count

    def candidates(self, w: Words, flags: dict[int, bytes]):
        """Starts of windows that hold an aligned anchor seen twice, with their hashes and checks."""
        hashes, at, known, which, count = self.anchors(w)
        twice = count > 1
        for bucket, part in by_bucket((known >> U64(32)).astype(np.int64)):
            if bucket in flags:
                twice[part] |= unbits(flags[bucket], part.stop - part.start)
        hit = at[twice[which]]
        if not len(hit):
            return hit, np.zeros(0, U64), np.zeros(0, np.uint32)
        begin = np.repeat(w.first[:-1], w.count)
        near = covered(len(w), np.maximum(hit - self.period + 1, begin[hit]), hit + 1)
        start = np.flatnonzero(near)
        start = start[start + self.length <= np.repeat(w.first[1:], w.count)[start]]
        if not len(start):
            return start, np.zeros(0, U64), np.zeros(0, np.uint32)
        key = windows(hashes, self.length)[start]
        check = (windows(mix(hashes), self.length, BASE2)[start] >> U64(32)).astype(np.uint32)
        return start, key, check


def _send_anchors(plan: Plan):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                number, _, w = plan.words(pa.Table.from_batches([batch.slice(i, 1)]))
                _, _, known, _, _ = plan.anchors(w)
                parts = by_bucket((known >> U64(32)).astype(np.int64))
                keys = [blob((known[p] & U64(0xFFFFFFFF)).astype("<u4")) for _, p in parts]
                if parts:
                    yield from sent([b for b, _ in parts], [number] * len(parts), keys).to_batches()

    return run


def mark_twice(table: pa.Table) -> pa.Table:
    """Which keys of each chunk also occur in another chunk of the bucket."""
    blobs = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
    known, count = np.unique(np.concatenate(blobs), return_counts=True)
    twice = known[count > 1]
    out = []
    for chunk, bucket, own in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), blobs):
        if len(twice):
            found = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own
            if found.any():
                out.append((chunk, bucket, bits(found)))
    return back(out)


def first_of(start: np.ndarray, doc: np.ndarray, ids: np.ndarray, position: np.ndarray, key: np.ndarray, check: np.ndarray):
    """Occurrences by (key, check, id, position); where each group of equal keys begins; the group of each."""
    order = np.lexsort((position, ids[doc], check, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _occurrences(plan: Plan, w: Words, ids: np.ndarray, flags: dict[int, bytes]):
    """Candidate windows; their first occurrences in this chunk, by bucket."""
    start, key, check = plan.candidates(w, flags)
    if not len(start):
        return None
    doc = np.searchsorted(w.first, start, "right") - 1
    position = start - w.first[doc]
    order, at, group = first_of(start, doc, ids, position, key, check)
    lead = order[at]
    bucket = ((key[lead] >> U64(40)) % U64(plan.buckets)).astype(np.int64)
    deal = np.argsort(bucket, kind="stable")
    return start, key, check, doc, position, order, group, lead, deal, by_bucket(bucket[deal])


def _send_windows(plan: Plan):
    def run(chunk: pa.Table, flagged: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return sent()
        number, ids, w = plan.words(chunk)
        flags = dict(zip(flagged.column("bucket").to_pylist(), flagged.column("bits").to_pylist()))
        out: list[list] = [[], [], [], [], [], []]
        found = _occurrences(plan, w, ids, flags)
        if found is not None:
            _, key, check, doc, position, _, _, lead, deal, parts = found
            for bucket, p in parts:
                own = lead[deal[p]]
                own = own[np.lexsort((position[own], doc[own]))]
                for column, x in zip(out, (bucket, number, blob(key[own]), blob(check[own]), blob(ids[doc[own]]), blob(position[own].astype("<u4")))):
                    column.append(x)
        for bucket, x in flags.items():  # goes along to the last pass, in a bucket of the chunk's own
            for column, y in zip(out, (-1 - number, number, x, None, None, np.int64(bucket).tobytes())):
                column.append(y)
        return sent(*out)

    return run


def mark_later(table: pa.Table) -> pa.Table:
    """Which chunk's first occurrences of a key come after one in another chunk."""
    out = []
    if table.column("bucket")[0].as_py() < 0:
        for chunk, x, b in zip(table.column("chunk").to_pylist(), table.column("keys").to_pylist(), table.column("starts").to_pylist()):
            out.append((chunk, -1 - int(np.frombuffer(b, np.int64)[0]), x))
        return back(out)
    blobs = [[np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("keys", "<u8"), ("checks", "<u4"), ("owners", "<i8"), ("starts", "<u4"))]
    sizes = [len(x) for x in blobs[0]]
    key, check, owner, start = (np.concatenate(x) for x in blobs)
    order = np.lexsort((start, owner, check, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.zeros(len(order), bool)
    later[order] = (owner[order] != owner[lead]) | (start[order] != start[lead])
    at = 0
    for chunk, bucket, n in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), sizes):
        if later[at : at + n].any():
            out.append((chunk, bucket, bits(later[at : at + n])))
        at += n
    return back(out)


def _remove(plan: Plan, full: bool):
    def run(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        flags, later = {}, {}
        for bucket, x in zip(answered.column("bucket").to_pylist(), answered.column("bits").to_pylist()):
            (flags if bucket < 0 else later)[-1 - bucket if bucket < 0 else bucket] = x
        if not chunk.num_rows:
            return pa.table([pa.array([], t) for t in TYPES], names=NAMES)
        _, ids, w = plan.words(chunk)
        gone = np.zeros(len(w), bool)
        found = _occurrences(plan, w, ids, flags)
        if found is not None:
            start, key, check, doc, position, order, group, lead, deal, parts = found
            after = np.zeros(len(lead), bool)
            for bucket, p in parts:
                if bucket in later:
                    which = deal[p]
                    own = lead[which]
                    sent_order = np.lexsort((position[own], doc[own]))
                    after[which[sent_order]] = unbits(later[bucket], len(own))
            first = lead[group]
            repeat = after[group] | (ids[doc[order]] != ids[doc[first]]) | (position[order] != position[first])
            at = start[order[repeat]]
            gone = covered(len(w), at, at + plan.length)
        return _result(ids, w, gone, full)

    return run


NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed_spans"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def _result(ids, w: Words, gone: np.ndarray, full: bool) -> pa.Table:
    body = w.data.tobytes()
    removed = np.concatenate([[0], np.cumsum(gone)])
    n_removed = removed[w.first[1:]] - removed[w.first[:-1]]
    digests, texts, spans = [], [], []
    for i, n in enumerate(n_removed.tolist()):
        own = body[w.offsets[i] : w.offsets[i + 1]].split()
        span = []
        if n:
            lost = gone[w.first[i] : w.first[i + 1]]
            own = list(compress(own, ~lost))
            if full:
                edge = np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))
                span = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
        kept = b" ".join(own)
        digests.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept.decode() if full else None)
        spans.append(span if full else None)
    values = [id_array(ids), pa.array(w.count, pa.int64()), pa.array(n_removed, pa.int64()), digests, texts, spans]
    return pa.table([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, TYPES)], names=NAMES)


def substring_dedup(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", full: bool = True, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256; with `full` also kept_text and removed_spans (word numbers).

    Words covered by a window of `length` words that also starts earlier are removed."""
    plan = Plan(length, bucket_count(text_bytes(docs, text_col), bucket_bytes))
    chunks = pack(docs, id_col, text_col, chunk_bytes)
    anchors = chunks.mapInArrow(_send_anchors(plan), SENT)
    twice = anchors.groupBy("bucket").applyInArrow(mark_twice, BACK)
    windows = chunks.groupBy("chunk").cogroup(twice.groupBy("chunk")).applyInArrow(_send_windows(plan), SENT)
    answers = windows.groupBy("bucket").applyInArrow(mark_later, BACK)
    out = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(plan, full), RESULT)
    return out if full else out.drop("kept_text", "removed_spans")

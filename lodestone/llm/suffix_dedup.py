"""Suffix-array dedup (operator 3): column-wise multi-document construction.

Every `length`-byte string belongs to its minimizer, the least hashed `seed`
bytes in it; the runs of strings with one minimizer (at most
``2 * length - seed`` bytes) are pieces, and equal strings always lie in pieces
of one minimizer.  Passes over a written table of chunks:

1. minimizers that are seen in more than one document, by buckets;
2. their pieces go to the bucket of the minimizer.  There the collection of
   pieces gets its Burrows-Wheeler transform and longest common prefixes column
   by column: in each round one symbol of every piece is inserted, the last
   one first, and the two sequential files are read and written once
   (:class:`Columns`).  Neighbours with common prefixes of `length` or more
   are equal strings, and the least document of each such run is its owner;
3. bytes covered by a string whose owner is a smaller document are removed.

Pieces without a shared minimizer, and those whose equals are the minimizer's only
pieces, hold no string that another piece has; only they are left out of collections.  Equal pieces of a chunk or bucket are one
piece of the collection, so copies cost one entry per chunk.  A collection's
files live in a folder of the task's own and go with it; nothing else reads them.

A very long text is a chunk by itself.  Null texts are empty.  A null id sorts before all others; rows with an equal
id count as the same document.  Matches are judged on the input.  An empty table
gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, bits, blob, bucket_count, by_bucket, carried_of, covered, free, id_array, lean, lean_group, lean_pair, ordered_spans, pack, text_bytes, unbits, unpack, windows

U64 = np.uint64
SENT = "bucket bigint, chunk bigint, keys binary, lens binary, owners binary, bytes binary"
BACK = "chunk bigint, bucket bigint, bits binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_bytes binary, removed_spans array<struct<start:bigint,end:bigint>>"
#: Symbols of one collection, as far as minimizers can be told apart.
BLOCK_SYMBOLS = 1 << 18
#: Entries of a file that are read at a time; the longest string, so that a piece's length and common prefixes go into two bytes.
FILE_BLOCK, MAX_LENGTH = 1 << 19, 32_000
#: Strings whose minimizers are found at a time, and the bits that number the seeds in them.
MINIMIZER_BLOCK, MINIMIZER_MASK = 1 << 17, (1 << 18) - 1
#: Bytes of text in a chunk, and for which one bucket is made: a bucket's pieces are about twice that.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20


class Columns:
    """Transform and common prefixes of a collection, kept as two sequential files.

    A round reads both files in blocks from the first entry on, and writes their
    successors the same way; nothing is read or written out of order."""

    def __init__(self, folder: str, kind: type, block: int = FILE_BLOCK):
        self.kinds, self.block, self.size = (np.dtype(np.uint8), np.dtype(kind)), block, 0
        self.now, self.next = ([open(os.path.join(folder, f"{x}{k}"), "w+b", buffering=0) for x in ("bwt", "lcp")] for k in (0, 1))

    def blocks(self):
        """First entry, transform and common prefixes of each block."""
        for f in self.now:
            f.seek(0)
        for a in range(0, self.size, self.block):
            n = min(self.block, self.size - a)
            yield a, *(np.frombuffer(f.read(n * k.itemsize), k) for f, k in zip(self.now, self.kinds))

    def write(self, blocks) -> None:
        """The successors, from blocks of transform and common prefixes; they replace the files."""
        size = 0
        for f in self.next:
            f.seek(0)
        for pair in blocks:
            size += len(pair[0])
            for f, k, x in zip(self.next, self.kinds, pair):
                f.write(np.ascontiguousarray(x, k).data)
        self.now, self.next, self.size = self.next, self.now, size

    def close(self) -> None:
        for f in (*self.now, *self.next):
            f.close()


def _least(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least common prefix over (low, high] for each pair."""
    if not len(low):
        return np.zeros(0, np.int64)
    go = np.argsort(high)
    pairs = np.empty(2 * len(low), np.int64)
    pairs[0::2], pairs[1::2] = low[go] + 1, high[go] + 1
    out = np.empty(len(low), np.int64)
    out[go] = np.minimum.reduceat(np.append(lcp, lcp[-1:]), pairs)[::2]
    return out


class Scan:
    """One pass over the files: of the entries `at` (ascending), by blocks and symbols, which they are (their
    numbers in `at`), their ranks, and the common prefixes with the entries of the same symbol before and
    after them (-1: there is none)."""

    def __init__(self, files: Columns, at: np.ndarray, counts: np.ndarray, cap: int):
        self.which, self.rank, self.before, self.after = (np.empty(len(at), np.int64) for _ in range(4))
        self.counts, self.seen, self.low = counts, np.cumsum(counts) - counts, np.full(256, cap, np.int64)  # low: since a symbol's last entry
        self.some, self.waits = np.zeros(256, bool), np.full(256, -1, np.int64)  # waits: whose next entry is still to come
        for a, bwt, lcp in files.blocks():
            i, j = np.searchsorted(at, [a, a + len(bwt)])
            self._block(slice(int(i), int(j)), at[i:j] - a, bwt, lcp, a > 0, a + len(bwt) < files.size)

    def _block(self, part: slice, at: np.ndarray, bwt: np.ndarray, lcp: np.ndarray, follows: bool, goes_on: bool) -> None:
        order = np.argsort(bwt, kind="stable")
        newest = np.zeros(len(bwt), bool)
        newest[at] = True
        p = np.flatnonzero(newest[order])
        own = order[p]
        symbol, counts = bwt[own], np.bincount(bwt, minlength=256) if follows or goes_on else self.counts
        first = np.cumsum(counts) - counts
        leads, trails = p == first[symbol], p == (first + counts - 1)[symbol]
        self.which[part] = part.start + np.searchsorted(at, own)
        self.rank[part] = p + (self.seen - first)[symbol]
        before, after = np.full(len(own), -1, np.int64), np.full(len(own), -1, np.int64)
        before[~leads] = _least(lcp, order[p[~leads] - 1], own[~leads])
        after[~trails] = _least(lcp, own[~trails], order[p[~trails] + 1])
        here = np.flatnonzero(counts)
        if follows:  # what the blocks before have of these symbols
            opens = np.full(256, 0, np.int64)
            opens[here] = np.minimum(self.low[here], np.minimum.accumulate(lcp)[order[first[here]]])
            known = leads & self.some[symbol]
            before[known] = opens[symbol[known]]
            met = here[self.waits[here] >= 0]
            self.after[self.waits[met]] = opens[met]
            self.waits[met] = -1
        self.before[part], self.after[part] = before, after
        if goes_on:
            closing = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.iinfo(lcp.dtype).max)
            self.low = np.minimum(self.low, closing[0])
            self.low[here] = closing[order[first[here] + counts[here] - 1] + 1]
            self.some[here] = True
            self.waits[symbol[trails]] = part.start + np.flatnonzero(trails)
            self.seen += counts


def build(data: np.ndarray, start: np.ndarray, lens: np.ndarray, files: Columns) -> None:
    """Insert one symbol of every piece each round, from the last to the first.

    Symbols are 1 to 255; 0 ends a piece.  Entry x of the files stands for the
    x-th suffix: the symbol before it, and its common prefix with suffix x - 1
    (as far as the file's numbers go)."""
    n, cap = len(lens), int(np.iinfo(files.kinds[1]).max) - 1
    begin = np.where(lens > 0, data[np.maximum(start + lens - 1, 0)], 0).astype(np.uint8)
    files.write((begin[a : a + files.block], np.zeros(len(begin[a : a + files.block]))) for a in range(0, n, files.block))
    counts = np.bincount(begin, minlength=256)
    at = np.arange(n)  # where each piece's newest suffix is
    piece = np.arange(n)
    for j in range(1, int(lens.max(initial=0)) + 1):
        go = lens[piece] >= j
        piece = piece[go]
        scan = Scan(files, at[go], counts, cap)
        by_rank = np.argsort(scan.rank, kind="stable")
        piece = piece[scan.which[by_rank]]
        own, after = (np.where(x < 0, 0, np.minimum(x, cap - 1) + 1)[by_rank] for x in (scan.before, scan.after))
        at = n + scan.rank[by_rank] - counts[0]
        more = lens[piece] > j
        symbol = np.where(more, data[np.where(more, start[piece] + lens[piece] - 1 - j, 0)], 0).astype(np.uint8)
        files.write(_inserted(files, at, symbol, own, scan.after[by_rank] >= 0, after))
        counts += np.bincount(symbol, minlength=256)


def _inserted(files: Columns, new: np.ndarray, symbol: np.ndarray, own: np.ndarray, follows: np.ndarray, after: np.ndarray):
    """Blocks of the files with entries inserted that get the places `new`; an entry that follows one gets a new common prefix."""
    into, size = new - np.arange(len(new)), files.size
    for a, bwt, lcp in files.blocks():
        i = int(np.searchsorted(into, a))
        j = int(np.searchsorted(into, a + len(bwt))) if a + len(bwt) < size else len(into)
        at = new[i:j] - (a + i)
        old = np.ones(len(bwt) + j - i, bool)
        old[at] = False
        bwt2, lcp2 = np.empty(len(old), bwt.dtype), np.empty(len(old), lcp.dtype)
        bwt2[old], bwt2[at] = bwt, symbol[i:j]
        lcp2[old], lcp2[at] = lcp, own[i:j]
        lcp2[at[follows[i:j]] + 1] = after[i:j][follows[i:j]]
        yield bwt2, lcp2


def suffix_classes(data: np.ndarray, start: np.ndarray, lens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, offset and class of every string of `length` in the pieces; equal strings have one class."""
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:
        files = Columns(folder, np.uint8 if length < 255 else np.uint16)
        try:
            build(data, start, lens, files)
            bwt, lcp = (np.concatenate(x) for x in list(zip(*((b, c) for _, b, c in files.blocks()))))
        finally:
            files.close()
    place = np.empty(len(bwt), np.int32)
    place[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)
    of = np.cumsum(lcp < length, dtype=np.int32)
    at, piece = np.arange(len(lens)), np.arange(len(lens))
    out: tuple[list, list, list] = ([], [], [])
    for j in range(1, int(lens.max(initial=0)) + 1):
        go = lens[piece] >= j
        piece = piece[go]
        at = place[at[go]]
        if j >= length:
            for x, y in zip(out, (piece, lens[piece] - j, of[at])):
                x.append(y)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in out)


class Plan:
    def __init__(self, length: int, buckets: int):
        if not 4 <= length <= MAX_LENGTH:
            raise ValueError(f"strings have 4 to {MAX_LENGTH} bytes here")
        self.length, self.buckets = length, buckets
        self.seed = max(2, min(20, length // 2))
        self.strings = length - self.seed + 1  # seeds in a string

    def pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Start, number of strings, minimizer hash and document of each piece."""
        n = len(data) - self.length + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, np.zeros(0, U64), none
        apart = np.zeros(n, bool)  # strings that would cross a document's end
        for end in offsets[1:-1].tolist():
            apart[max(0, end - self.length + 1) : end] = True
        parts = [self._runs(data[a : a + MINIMIZER_BLOCK + self.length - 1], apart[a : a + MINIMIZER_BLOCK], a) for a in range(0, n, MINIMIZER_BLOCK)]
        start, where, stop, minimizer = (np.concatenate(x) for x in zip(*parts))
        # runs that go on in the next block; a document's first string begins one
        new = np.ones(len(start), bool)
        new[1:] = (where[1:] != where[:-1]) | (start[1:] != stop[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(start)) - 1
        return start[at], stop[last] - start[at], minimizer[at], np.searchsorted(offsets, start[at], "right") - 1

    def _runs(self, data: np.ndarray, apart: np.ndarray, base: int):
        """Of a block's strings: where runs with one minimizer start, where that minimizer is, where they stop, and its hash."""
        seeds, n = windows(data, self.seed, table=BYTE_CODE), len(apart)
        best = (seeds & ~U64(MINIMIZER_MASK)) | np.arange(len(seeds), dtype=U64)
        width = 1
        while width * 2 <= self.strings:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < self.strings:
            more = self.strings - width
            best = np.minimum(best[:-more], best[more:])
        where = (best & U64(MINIMIZER_MASK)).astype(np.int32)
        begin = np.ones(n, bool)
        begin[1:] = (where[1:] != where[:-1]) | apart[:-1]
        begin |= apart
        edges = np.append(np.flatnonzero(begin), n)
        use = ~apart[edges[:-1]]
        start, stop = edges[:-1][use], edges[1:][use]
        at = where[start]
        return start + base, at.astype(np.int64) + base, stop + base, seeds[at]

    def keys(self, minimizer: np.ndarray, owner: np.ndarray):
        """Sorted distinct (bucket, key) pairs, each piece's pair, and whether a pair is in two documents of the chunk."""
        pair = ((minimizer >> U64(40)) % U64(self.buckets)) << U64(32) | (minimizer & U64(0xFFFFFFFF))
        known, which = np.unique(pair, return_inverse=True)
        low = np.full(len(known), np.iinfo(np.int64).max)
        high = np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(low, which, owner)
        np.maximum.at(high, which, owner)
        return known, which, low != high

    def shared(self, chunk: pa.Table, flags: dict[int, bytes]):
        """The chunk's shared pieces; each one's kind (equal pieces); each kind's first piece, which has the least document."""
        number, ids, data, offsets = unpack(chunk)
        start, count, minimizer, doc = self.pieces(data, offsets)
        owner = ids[doc]
        known, which, twice = self.keys(minimizer, owner)
        for bucket, part in by_bucket((known >> U64(32)).astype(np.int64)):
            if bucket in flags:
                twice[part] |= unbits(flags[bucket], part.stop - part.start)
        use = twice[which] if len(which) else np.zeros(0, bool)
        start, count, minimizer, owner, pair = start[use], count[use], minimizer[use], owner[use], known[which[use]] if len(which) else known
        text = ordered_spans(data, start, start + count + self.length - 1)
        _, first, kind = np.unique(text, return_index=True, return_inverse=True)
        bucket = (pair[first] >> U64(32)).astype(np.int64)
        deal = np.argsort(bucket, kind="stable")
        return number, ids, data, offsets, start, count, owner, minimizer, kind, first, deal, by_bucket(bucket[deal])


def gather(data: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The spans of `data`, one after the other."""
    if not len(start):
        return np.zeros(0, np.uint8)
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
    return data[np.arange(int(lens.sum())) + shift]


def sent(out: list[list]) -> pa.Table:
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array(x, t) for x, t in zip(out, types)], names=["bucket", "chunk", "keys", "lens", "owners", "bytes"])


def back(out: list[tuple]) -> pa.Table:
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["chunk", "bucket", "bits"])


def _send_minimizers(plan: Plan):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                number, ids, data, offsets = unpack(batch, i)
                _, _, minimizer, doc = plan.pieces(data, offsets)
                known, _, _ = plan.keys(minimizer, ids[doc])
                out: list[list] = [[] for _ in range(6)]
                for bucket, p in by_bucket((known >> U64(32)).astype(np.int64)):
                    for column, x in zip(out, (bucket, number, blob((known[p] & U64(0xFFFFFFFF)).astype("<u4")), None, None, None)):
                        column.append(x)
                yield from sent(out).to_batches()

    return run


def mark_shared(table: pa.Table) -> pa.Table:
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


def _send_pieces(plan: Plan):
    def run(chunk: pa.Table, flagged: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        if not chunk.num_rows:
            return sent(out)
        flags = dict(zip(flagged.column("bucket").to_pylist(), flagged.column("bits").to_pylist()))
        number, ids, data, offsets, start, count, owner, minimizer, kind, first, deal, parts = plan.shared(chunk, flags)
        for bucket, p in parts:
            own = first[deal[p]]
            lens = count[own] + plan.length - 1
            for column, x in zip(out, (bucket, number, blob(minimizer[own]), blob(lens.astype("<u2")), blob(owner[own]), blob(gather(data, start[own], lens)))):
                column.append(x)
        for bucket, x in flags.items():  # goes along to the last pass, in a bucket of the chunk's own
            for column, y in zip(out, (-1 - number, number, x, None, None, np.int64(bucket).tobytes())):
                column.append(y)
        return sent(out)

    return run


def _match(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        chunks, buckets, keys = (table.column(c).to_pylist() for c in ("chunk", "bucket", "keys"))
        if buckets[0] < 0:
            return back([(c, -1 - int(np.frombuffer(b, np.int64)[0]), x) for c, x, b in zip(chunks, keys, table.column("bytes").to_pylist())])
        minimizer = np.concatenate([np.frombuffer(x, "<u8") for x in keys])
        lens = np.concatenate([np.frombuffer(x, "<u2") for x in table.column("lens").to_pylist()]).astype(np.int64)
        owner = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("owners").to_pylist()])
        data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        start = np.concatenate([[0], np.cumsum(lens)[:-1]])
        data = np.where(data == 0, 0xFF, data).astype(np.uint8)  # no UTF-8 text has this byte
        text = ordered_spans(data, start, start + lens)
        # one piece of each kind, by minimizer; its owner is the least
        order = np.lexsort((owner, text, minimizer))
        new = np.ones(len(order), bool)
        new[1:] = (text[order][1:] != text[order][:-1]) | (minimizer[order][1:] != minimizer[order][:-1])
        lead = order[new]
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        edge = np.ones(len(lead) + 1, bool)
        edge[1:-1] = minimizer[lead][1:] != minimizer[lead][:-1]
        count = lens[lead] - plan.length + 1
        base = np.concatenate([[0], np.cumsum(count)])
        least = np.empty(base[-1], np.int64)
        edges = np.flatnonzero(edge)
        lone = np.repeat(np.diff(edges) == 1, np.diff(edges))  # a collection of one piece: no other holds its strings
        least[gather_index(base[:-1][lone], count[lone])] = np.repeat(owner[lead[lone]], count[lone])
        many = np.flatnonzero(~lone)
        edges = np.searchsorted(many, edges)
        edges = np.unique(edges)
        size = np.concatenate([[0], np.cumsum(lens[lead[many]])])
        a = 0
        while a < len(many):  # collections of whole minimizers
            i = np.searchsorted(edges, a)
            b = int(edges[max(i + 1, np.searchsorted(size[edges], size[a] + BLOCK_SYMBOLS, "right") - 1)])
            own = lead[many[a:b]]
            symbols = gather(data, start[own], lens[own])
            piece, offset, of = suffix_classes(symbols, np.concatenate([[0], np.cumsum(lens[own])[:-1]]), lens[own], plan.length)
            least_of = np.full(int(of.max(initial=0)) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least_of, of, owner[own][piece])
            least[base[many[a:b]][piece] + offset] = least_of[of]
            a = b
        out, at = [], 0
        for chunk, bucket, key in zip(chunks, buckets, keys):
            n = len(key) // 8
            k = kind[at : at + n]
            c = count[k]
            covered_by = least[gather_index(base[k], c)] < np.repeat(owner[at : at + n], c)
            if covered_by.any():
                out.append((chunk, bucket, bits(covered_by)))
            at += n
        return back(out)

    return run


def gather_index(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
    return np.arange(int(lens.sum())) + shift


NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "removed_spans"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def _gone(plan: Plan, chunk: pa.Table, answered: pa.Table):
    """Ids, bytes and offsets of a chunk, and which bytes are covered by a string of a smaller document."""
    flags, owned = {}, {}
    for bucket, x in zip(answered.column("bucket").to_pylist(), answered.column("bits").to_pylist()):
        (flags if bucket < 0 else owned)[-1 - bucket if bucket < 0 else bucket] = x
    _, ids, data, offsets, start, count, owner, _, kind, first, deal, parts = plan.shared(chunk, flags)
    gone = np.zeros(len(data), bool)
    if len(start):
        c = count[first]
        base = np.concatenate([[0], np.cumsum(c)])
        earlier = np.zeros(base[-1], bool)  # for each string of each kind: some smaller document has it
        for bucket, p in parts:
            if bucket in owned:
                which = deal[p]
                earlier[gather_index(base[which], c[which])] = unbits(owned[bucket], int(c[which].sum()))
        lost = earlier[gather_index(base[kind], count)] | np.repeat(owner != owner[first][kind], count)
        at = gather_index(start, count)[lost]
        gone = covered(len(data), at, at + plan.length)
    return ids, data, offsets, gone


def _remove(plan: Plan, full: bool):
    def run(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.table([pa.array([], t) for t in TYPES], names=NAMES)
        ids, data, offsets, gone = _gone(plan, chunk, answered)
        kept, removed = data[~gone], np.concatenate([[0], np.cumsum(gone)])
        n_removed = np.diff(removed[offsets])
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        begin[cut] = gone[cut]
        n_spans = np.diff(np.concatenate([[0], np.cumsum(begin)])[offsets])
        body, cuts = kept.tobytes(), offsets - removed[offsets]
        parts_of = [body[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        lists = []
        if full:
            for i, n in enumerate(n_spans.tolist()):
                own = np.diff(np.concatenate([[0], gone[offsets[i] : offsets[i + 1]].astype(np.int8), [0]])) if n else np.zeros(0)
                lists.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1))])
        none = [None] * len(ids)
        values = [id_array(ids), np.diff(offsets), n_removed, n_spans, [hashlib.sha256(x).hexdigest() for x in parts_of], parts_of if full else none, lists if full else none]
        return pa.table([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, TYPES)], names=NAMES)

    return run


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", full: bool = True, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `full` also kept_bytes and removed_spans.

    Bytes covered by a string of `length` bytes that also starts in a document with a smaller id are removed."""
    out = _passes(docs, length, id_col, text_col, chunk_bytes, bucket_bytes, (), lambda plan: _remove(plan, full), RESULT)
    return out if full else out.drop("kept_bytes", "removed_spans")


def _passes(docs: DataFrame, length: int, id_col: str, text_col: str, chunk_bytes: int, bucket_bytes: int, carry, last, schema) -> DataFrame:
    plan = Plan(length, bucket_count(text_bytes(docs, text_col), bucket_bytes))
    chunks = pack(docs, id_col, text_col, chunk_bytes, carry)
    shared = chunks.mapInArrow(lean(_send_minimizers(plan)), SENT).groupBy("bucket").applyInArrow(lean_group(mark_shared), BACK)
    pieces = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(lean_pair(_send_pieces(plan)), SENT)
    answers = pieces.groupBy("bucket").applyInArrow(lean_group(_match(plan)), BACK)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean_pair(last(plan)), schema)


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`docs` with what is left of each text; bytes of characters that were cut through are dropped, and so are texts of which nothing is left.

    The other columns travel with the chunks."""
    names = docs.columns
    carry = [c for c in names if c != text_col]
    worded = free("has_text", names)  # tells null texts from empty ones

    def last(plan: Plan):
        def run(chunk: pa.Table, answered: pa.Table) -> pa.Table:
            if not chunk.num_rows:
                return pa.table({})
            _, data, offsets, gone = _gone(plan, chunk, answered)
            others = carried_of(chunk)
            removed = np.concatenate([[0], np.cumsum(gone)])
            cuts, body = offsets - removed[offsets], data[~gone].tobytes()
            touched = np.diff(removed[offsets]) > 0
            texts = [body[a:b].decode("utf-8", "ignore" if t else "strict") for a, b, t in zip(cuts[:-1], cuts[1:], touched)]
            null = np.array([x is None for x in others.column(worded).to_pylist()])
            keep = ~touched | np.array([bool(x) for x in texts], bool)
            columns = {text_col: pa.array(texts, pa.string(), mask=null)}
            for c in carry:
                columns[c] = others.column(c)
            if chars_col:
                n = [len(x) if t else old for x, t, old in zip(texts, touched, others.column(chars_col).to_pylist())]
                columns[chars_col] = pa.array(n, others.schema.field(chars_col).type)
            return pa.table([columns[c] for c in names], names=names).filter(pa.array(keep))

        return run

    marked = docs.withColumn(worded, F.when(F.col(text_col).isNotNull(), F.lit(True)))
    return _passes(marked, length, id_col, text_col, chunk_bytes, bucket_bytes, [*carry, worded], last, docs.schema)

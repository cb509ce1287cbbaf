"""What several operators share: a written table of text chunks, vectorised
word and byte hashing, and blobs that are dealt to buckets and back.

*Chunks.*  :func:`pack` writes documents as rows of a few megabytes of text
each, in the shared folder that ``spark.checkpoint.dir`` names.  A chunk is
balanced by bytes, so neither a hot key nor a group of copies makes one larger,
and since the table is written, a lost executor re-reads it unchanged.

*Buckets.*  Passes that must meet equal hashes send one blob per chunk and
bucket, in which each hash occurs once; so a hash that fills a third of the
corpus costs its bucket one entry per chunk.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.shared import dealt, shared_dir, written  # noqa: F401  (used by the operators)

#: Bytes of text in a chunk; a longer document is a chunk by itself.
CHUNK_BYTES = 4 << 20
#: Bytes of text for which one bucket is made.
BUCKET_BYTES = 24 << 20
#: Bytes of an Arrow batch, unless the session names a bound.
ARROW_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: A null identifier sorts before all others.
NULL_ID = np.iinfo(np.int64).min

U64 = np.uint64
_RNG = np.random.default_rng(20_240_611)
BYTE_CODE = _RNG.integers(0, 2**64 - 1, 256, dtype=U64)
BASE = int(_RNG.integers(2**62, 2**63 - 1)) | 1
BASE2 = int(_RNG.integers(2**62, 2**63 - 1)) | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Fixed values of the contracts: bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for a context; Arrow batches get a bound by bytes where the session has none."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(ARROW_BYTES))
    if getattr(sc, "_lodestone_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(path := os.path.join(folder, "lodestone-package.zip"), "w") as z:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._lodestone_shipped = True


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _TRIM = None


def give_back() -> None:
    """Return to the system what this process has freed."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(run):
    """`run` for mapInArrow, giving back what it has freed at the end of a task.

    A worker that waits for its next task keeps up its freed memory, and other workers may start beside it."""

    def batched(batches):
        yield from run(batches)
        give_back()

    return batched


def lean_group(run):
    """`run` for applyInArrow, giving back what it has freed after each group."""

    def grouped(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return grouped


def lean_pair(run):
    """`run` for applyInArrow on cogroups, giving back what it has freed after each group."""

    def paired(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return paired


def free(name: str, *taken) -> str:
    """`name`, with underscores after it until none of the taken names is the same but for case."""
    used = {x.lower() for names in taken for x in names}
    while name.lower() in used:
        name += "_"
    return name


#: A key of more than one in so many rows counts as hot; so there are at most so many hot keys.
HOT_KEYS = 1_000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Left join on a binary key that is unique in `right`; `rows`: how many rows of the left side have it, of `total`.

    The right side's hot keys, HOT_KEYS at most, are broadcast, and left rows that have one don't go to the others' exchange by that key."""
    names = [c for c in right.columns if c != key]
    near = right.where(F.col(rows) * HOT_KEYS > total).select(F.col(key).alias("hot key"), F.struct(*names).alias("hot"))
    rest = right.where(F.col(rows) * HOT_KEYS <= total).select(F.col(key).alias("rest key"), F.struct(*names).alias("rest"))
    both = left.join(F.broadcast(near), F.col(key) == F.col("hot key"), "left")
    spread = F.unhex(F.md5(F.concat(F.col(key), F.xxhash64(*left.columns).cast("string").cast("binary"))))  # no key of the right side
    both = both.withColumn("at", F.when(F.col("hot").isNull(), F.col(key)).otherwise(spread))
    both = both.join(rest, F.col("at") == F.col("rest key"), "left").withColumn("found", F.coalesce("hot", "rest"))
    return both.select(*left.columns, *(F.col("found")[c].alias(c) for c in names))


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts, counted by one scan."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def bucket_count(total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(4, -(-total_bytes // bucket_bytes))


# ---------------------------------------------------------------- Arrow texts


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def ids_of(column) -> np.ndarray:
    """An integer column as int64; null becomes the least value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False), np.int64)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def cuts(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes, or one row."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def slices(batches, limit: int = CHUNK_BYTES, text: int = 1):
    """Batches again, with at most `limit` bytes of text in column `text`, or one row."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        for a, b in cuts(offsets, limit):
            yield batch.slice(a, b - a)


def row_filter(docs: DataFrame, text_col: str, make_mask, limit: int = CHUNK_BYTES) -> DataFrame:
    """Rows of `docs`, all columns, for which a mask over (bytes, offsets) of the texts is set; make_mask() gives the mask function on an executor.

    limit: bytes of text that are looked at together, or one text."""
    at = docs.columns.index(text_col)

    def run(batches):
        mask = make_mask()
        for piece in slices(batches, limit, at):
            keep = mask(*utf8(piece.column(at)))
            if keep.any():
                yield piece.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)


# ---------------------------------------------------------------- hashing


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        both = []
        for b in (base, _inverse(base)):
            x = np.full(size, b, U64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _POWERS[base] = have = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix(codes: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums of codes[i] * base**i, from which every span's hash follows."""
    s = np.zeros(len(codes) + 1, U64)
    np.multiply(codes, powers(len(codes) + 1, base)[0][: len(codes)], out=s[1:])
    np.cumsum(s[1:], out=s[1:])
    return s


def spans(s: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of the spans [start, end), which do not depend on where they lie."""
    return mix((s[end] - s[start]) * powers(len(s), base)[1][start] + (end - start).astype(U64))


def rolling(s: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Hashes of all spans of `width`, by start."""
    n = len(s) - width
    if n <= 0:
        return np.zeros(0, U64)
    x = s[width:] - s[:n]
    x *= powers(len(s), base)[1][:n]
    x += U64(width)
    return mix(x)


#: Bytes (or words) that are hashed at a time, so that powers and sums stay in the processor's cache.
HASH_BLOCK = 1 << 17


def windows(codes: np.ndarray, width: int, base: int = BASE, table: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all windows of `width` codes, by start, as rolling() has them; `table`: what each of the codes stands for."""
    n = len(codes) - width + 1
    out = np.empty(max(0, n), U64)
    for a in range(0, n, HASH_BLOCK):
        own = codes[a : min(a + HASH_BLOCK, n) + width - 1]
        out[a : a + HASH_BLOCK] = rolling(prefix(own if table is None else table[own], base), width, base)
    return out


def ordered_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE, table: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Hashes of spans of `data`, as spans() has them; neither starts nor ends may decrease."""
    out = np.empty(len(start), U64)
    for a, b in cuts(np.append(start, start[-1] + 1 if len(start) else 0), HASH_BLOCK):
        if b > a and b <= len(start):
            low = int(start[a])
            out[a:b] = spans(prefix(table[data[low : int(end[b - 1])]], base), start[a:b] - low, end[a:b] - low, base)
    return out


class Words:
    """Words of texts that lie one after the other in `data`.

    start, end: of each word; first: per document, the number of its first word
    (one more entry than documents)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray):
        n = len(data)
        inside = word_byte[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        begin[cut] = inside[cut]
        stop[cut - 1] = inside[cut - 1]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, base: int = BASE) -> np.ndarray:
        return ordered_spans(self.data, self.start, self.end, base)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def position(self) -> np.ndarray:
        """Of each word in its document."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.count)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans [start, end)."""
    d = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(d)[:n] > 0


# ---------------------------------------------------------------- chunks

CHUNK_SCHEMA = "chunk bigint, ids array<bigint>, lens binary, payload binary, carried binary"


def chunk_row(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, chunk: int, carried: pa.Table | None = None) -> pa.RecordBatch:
    """One chunk, its documents by identifier, those of one identifier by text; `carried`: their other columns."""
    order = np.argsort(ids, kind="stable")
    if len(order) > 1 and np.any(ids[order][1:] == ids[order][:-1]):
        body = data.tobytes()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], body[offsets[i] : offsets[i + 1]])))
    lens = np.diff(offsets)[order]
    body = b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in order)
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([id_array(ids[order]).to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (lens.astype("<i8").tobytes(), zstandard.ZstdCompressor(level=3).compress(body), None if carried is None else table_bytes(carried.take(pa.array(order)))))],
        names=["chunk", "ids", "lens", "payload", "carried"],
    )


def table_bytes(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def carried_of(table: pa.Table | pa.RecordBatch, row: int = 0) -> pa.Table:
    """The other columns of a chunk's documents, in the order of unpack()."""
    return pa.ipc.open_stream(table.column("carried")[row].as_buffer()).read_all()


def _packer(limit: int):
    def run(batches):
        base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def emit():
            ids = np.concatenate([x[0] for x in held])
            lens = np.concatenate([np.diff(x[2]) for x in held])
            data = np.concatenate([x[1] for x in held])
            carried = pa.Table.from_batches([x[3] for x in held]) if held[0][3].num_columns else None
            return chunk_row(ids, data, np.concatenate([[0], np.cumsum(lens)]), base + number, carried)

        for piece in slices(batches, limit):
            data, offsets = utf8(piece.column(1))
            if held and size + len(data) > limit:
                yield emit()
                number, held, size = number + 1, [], 0
            held.append((ids_of(piece.column(0)), data, offsets, pa.RecordBatch.from_arrays(piece.columns[2:], names=piece.schema.names[2:])))
            size += len(data)
        if held:
            yield emit()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, carry: list[str] = ()) -> DataFrame:
    """Documents as a written table of chunks, with the columns `carry` if asked for."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("bigint").alias(free("id", docs.columns)), F.col(text_col).cast("string").alias(free("whole_text", docs.columns)), *carry)
    return written(own.mapInArrow(lean(_packer(chunk_bytes)), CHUNK_SCHEMA), "chunks")


def unpack(table: pa.Table | pa.RecordBatch, row: int = 0) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Chunk number, ids, bytes and offsets of one chunk row."""
    ids = np.array([NULL_ID if x is None else x for x in table.column("ids")[row].as_py()], np.int64)
    lens = np.frombuffer(table.column("lens")[row].as_py(), "<i8")
    body = zstandard.ZstdDecompressor().decompress(table.column("payload")[row].as_py())
    return table.column("chunk")[row].as_py(), ids, np.frombuffer(body, np.uint8), np.concatenate([[0], np.cumsum(lens)])


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def by_bucket(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """Of a sorted array: each value and where it lies."""
    if not len(bucket):
        return []
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return [(int(bucket[a]), slice(int(a), int(b))) for a, b in zip(at, [*at[1:], len(bucket)])]


def bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unbits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)

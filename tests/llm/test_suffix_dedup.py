"""Operator 3 against a plain version; the column-wise construction against sorted suffixes."""

import random

import numpy as np
import pytest

from lodestone.llm import suffix_dedup as S

from . import brute
from .conftest import rows_of
from .test_text_passes import corpus, frame


@pytest.mark.parametrize("block", [3, 64, 1 << 18])
@pytest.mark.parametrize("seed", range(6))
def test_columns_are_the_suffix_array(tmp_path, seed, block):
    r = random.Random(seed)
    strings = [bytes(r.choice(b"ab" if seed % 2 else b"abcde") for _ in range(r.randint(0, 20))) for _ in range(r.randint(1, 30))]
    lens = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings) + b"x", np.uint8)
    start = np.concatenate([[0], np.cumsum(lens)[:-1]])
    S.build(data, start, lens, files := S.Columns(str(tmp_path), np.uint8, block))
    bwt, lcp = (np.concatenate(x) for x in zip(*((b, c) for _, b, c in files.blocks())))
    files.close()
    suffixes = sorted((s[k:] + b"\0", i, s[k - 1 : k] or b"\0") for i, s in enumerate(strings) for k in range(len(s) + 1))
    assert bytes(bwt) == b"".join(x[2] for x in suffixes)

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) - 1 and a[n] == b[n]:
            n += 1
        return n

    assert lcp.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]


@pytest.mark.parametrize("length", [12, 50])
def test_suffix_dedup(spark, length, monkeypatch):
    docs = corpus(length, vocabulary=6) + [(300, "\0" * 70 + "abc"), (301, "z\0" + "\0" * 69), (302, "é" * 60), (303, "b" + "é" * 40)]
    got = rows_of(S.suffix_dedup(frame(spark, docs), length, full=False, chunk_bytes=900, bucket_bytes=3000))
    assert sorted(got, key=str) == sorted(brute.suffix_dedup(docs, length), key=str)


@pytest.mark.parametrize("length", [254, 255, 300])
def test_long_strings(spark, length):
    r = random.Random(length)
    body = "".join(r.choice("abcdefgh ") for _ in range(900))
    docs = [(1, body[:700]), (2, "x" + body[200:650]), (3, body[100 : 100 + length - 1]), (4, "yy" + body[500:] + "z"), (5, None)]
    got = rows_of(S.suffix_dedup(frame(spark, docs), length, full=False, chunk_bytes=900, bucket_bytes=3000))
    assert sorted(got, key=str) == sorted(brute.suffix_dedup(docs, length), key=str)
    assert any(x[2] for x in got)


@pytest.mark.parametrize("length", [3, 32_001])
def test_lengths_that_have_no_pieces(spark, length):
    with pytest.raises(ValueError):
        S.suffix_dedup(frame(spark, [(1, "a")]), length)


def test_small_collections(monkeypatch):
    import pyarrow as pa

    r = random.Random(1)
    monkeypatch.setattr(S, "BLOCK_SYMBOLS", 300)
    plan = S.Plan(12, 1)
    body = ["".join(r.choice("abc") for _ in range(200)) for _ in range(4)]
    docs = [(i, body[r.randint(0, 3)][r.randint(0, 90) :] + "".join(r.choice("abc") for _ in range(30))) for i in range(12)]
    from lodestone.llm.common import chunk_row

    tables = []
    for k in range(3):
        own = [(i, t.encode()) for i, t in docs[4 * k : 4 * k + 4]]
        lens = np.array([len(t) for _, t in own])
        tables.append(pa.Table.from_batches([chunk_row(np.array([i for i, _ in own]), np.frombuffer(b"".join(t for _, t in own), np.uint8), np.concatenate([[0], np.cumsum(lens)]), k)]))
    first = pa.concat_tables([pa.Table.from_batches(list(S._send_minimizers(plan)(t.to_batches()))) for t in tables])
    flags = S.mark_shared(first)
    pick = lambda t, k: t.filter(pa.compute.equal(t.column("chunk"), k))
    pieces = pa.concat_tables([S._send_pieces(plan)(t, pick(flags, k)) for k, t in enumerate(tables)])
    answers = pa.concat_tables([S._match(plan)(pieces.filter(pa.compute.equal(pieces.column("bucket"), b))) for b in set(pieces.column("bucket").to_pylist())])
    out = [tuple(x[n] for n in S.NAMES[:5]) for k, t in enumerate(tables) for x in S._remove(plan, True)(t, pick(answers, k)).to_pylist()]
    assert sorted(out) == sorted(brute.suffix_dedup(docs, 12))


def test_whole_rows_and_empty_tables(spark):
    same = "the quick brown fox jumps over"
    got = {r.doc_id: r for r in S.suffix_dedup(frame(spark, [(1, same), (2, "A " + same + "!")]), 12).collect()}
    assert bytes(got[2].kept_bytes) == b"A !" and [tuple(s) for s in got[2].removed_spans] == [(2, 2 + len(same))]
    assert S.suffix_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0

"""Operators 5 and 7."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import mixing as M
from lodestone.llm import warc as A

from .conftest import rows_of


def test_targets_share_the_excess():
    assert M.targets([100, 100], [1, 3]) == [50, 150]
    assert M.targets([10, 100, 100], [3, 1, 1]) == [30, 90, 90]
    assert M.targets([], []) == [] and M.targets([0, 5], [1, 1]) == [0, 5]
    assert sum(M.targets([5, 50, 500, 5000], [6, 4, 2, 1])) == pytest.approx(5555)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation(n):
    assert sorted(M.permute(np.arange(n), n, 5).tolist()) == list(range(n))
    if n > 100:
        assert (M.permute(np.arange(n), n, 5) != M.permute(np.arange(n), n, 6)).any()


def test_shards_take_the_quotas():
    quota = [700, 0, 55, 3]
    shards = list(M.shard_counts(quota, 100, 1))
    assert np.sum([t for _, t, _ in shards], axis=0).tolist() == quota
    assert all(t.sum() == 100 for _, t, _ in shards[:-1])


def test_mix(spark):
    r = random.Random(4)
    docs = [(i, " ".join("w" for _ in range(r.randint(0, 90))), r.choice(["ä", "b", "B", None, "hot", "hot", "hot"])) for i in range(900)]
    docs += [(5, None, "b"), (5, "x " * 2000, "b"), (None, "q", "zero"), (7, "", "nothing"), (7, "", "nothing")]
    df = spark.createDataFrame([(*d, 1.5, 2) for d in docs], "doc_id bigint, text string, source string, size double, block int").repartition(5)
    kw = dict(block_words=16, segment_words=3000)
    got = rows_of(M.mix_sources(df, **kw))
    assert sorted(got, key=str) == sorted(rows_of(M.mix_sources(df.repartition(2), **kw)), key=str)
    assert len(got) == len(docs)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, M.targets([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])))
    for s in order:
        own = [x for x in got if x[2] == s]
        assert all(x[3] == sizes[s] and x[4] == pytest.approx(target[s]) for x in own)
        assert abs(sum(x[5] for x in own) - target[s]) <= max(40, 0.03 * target[s])
    assert all(0 <= x[5] <= 3 * x[1] for x in got)
    assert M.mix_sources(df.limit(0)).count() == 0


def test_the_mix_is_in_shards(spark):
    r = random.Random(6)
    docs = [(i, r.choice(["", " "]) + "".join(f"{i}.{k}" + r.choice([" ", "\n", " \t"]) for k in range(r.randint(0, 90))), r.choice("abbc"), i * 2) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, slot bigint").repartition(4)
    kw = dict(block_words=16, segment_words=2000, shard_slots=100)
    rows = M.mixed_parts(df, **kw).collect()
    slots, taken, texts = {}, {}, {d[0]: d for d in docs}
    for x in sorted(rows, key=lambda x: (x.shard, x.slot, x.place)):
        slots.setdefault((x.shard, x.slot), []).append(x)
        taken[x.doc_id] = taken.get(x.doc_id, 0) + x.words
        assert x.words == len(x.text.split()) and x.text in texts[x.doc_id][1] and x.source == texts[x.doc_id][2] and x.carried.slot == 2 * x.doc_id
    shards = max(s for s, _ in slots) + 1
    assert shards > 5 and sorted(slots) == sorted((s, i) for s in range(shards) for i in range(100) if s < shards - 1 or i <= max(k for a, k in slots if a == s))
    for own in slots.values():  # one block of one source, in order
        assert sum(x.words for x in own) <= 16 and len({x.source for x in own}) == 1 and [x.place for x in own] == list(range(len(own)))
    for s in range(shards - 1):  # a shard is a mix
        assert len({own[0].source for (a, _), own in slots.items() if a == s}) == 3
    assert {x.doc_id: x.taken for x in M.mix_sources(df, **kw).collect() if x.taken} == taken


def test_parts_are_the_text():
    text = ["", "  a b\tc ", " \n", "é" * 3, "x y z w " * 9]
    data, offsets = np.frombuffer("".join(text).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in text])])
    size, doc, block, words, parts = M.cut_parts(data, offsets, 3)
    assert size.tolist() == [len(t.split()) for t in text] and words.tolist() == [len(x.split()) for x in parts]
    for i, t in enumerate(text):
        assert b"".join(p for p, d in zip(parts, doc) if d == i).decode() == (t if t.split() else "")
    n = int(size.sum())
    assert np.bincount(block, words).tolist() == [min(3, n - a) for a in range(0, n, 3)]


def brute_warc(pages, least):
    newest = {}
    for i, h in pages:
        b = (h or "").encode()
        if len(b) >= least:
            newest[b] = max(newest.get(b, -1), -1 if i is None else i)
    out = []
    for i, h in pages:
        b = (h or "").encode()
        top = newest.get(b, i)
        top = None if top == -1 else top
        kind = "response" if top == i or top is None else "revisit"
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, top if kind == "revisit" else None))
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = [(1, "same"), (9, "same"), (3, "same"), (4, None), (5, ""), (6, "é" * 5000), (7, "WARC/1.1\r\n\r\n" * 30), (None, "same"), (None, "alone"), (9, "same"), (2, "é" * 5000)]
    df = spark.createDataFrame([(i, f"http://h/ü\n{i}", h, 3) for i, h in pages], "page_id bigint, url string, html string, size int").repartition(3)
    archive = A.write(df, min_bytes=least, chunk_bytes=777)
    assert archive.agg({"chunk_no": "max"}).first()[0] > 10
    back = A.read(archive)
    assert back.where("not verified").count() == 0
    got = rows_of(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    assert sorted(got, key=str) == sorted(brute_warc(pages, least), key=str)
    stream = b"".join(A.archive_bytes(archive))
    for step in (1 << 20, 13):
        parsed = list(A.parse_stream(stream[a : a + step] for a in range(0, len(stream), step)))
        assert len(parsed) == len(pages)
        assert all(x["fields"]["warc-payload-digest"] == "sha1:" + A.digest_text(x["sha1"]) for x in parsed if x["fields"]["warc-type"] == "response")
    assert gzip.decompress(gzip.compress(stream)) == stream


def test_damage_is_found(spark):
    from pyspark.sql import functions as F

    archive = A.write(spark.createDataFrame([(1, "u", "abc" * 900)], "page_id bigint, url string, html string"), chunk_bytes=500)
    with pytest.raises(Exception, match="damaged|missing"):
        A.read(archive.where(F.col("chunk_no") != 2)).collect()
    with pytest.raises(ValueError):
        list(A.parse_stream([b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"]))


def test_short_records_are_read_where_they_lie(spark):
    """A record that fits a chunk is one row; only longer ones are exchanged; a cut row is found."""
    from pyspark.sql import functions as F

    pages = [(i, "u", str(i) * 40) for i in range(50)] + [(100, "u", "long " * 900), (101, "u", None)]
    archive = A.write(spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3), chunk_bytes=1500)
    assert archive.groupBy("record").count().where("count > 1").count() == archive.where("chunk_no = 0 AND NOT whole").count() == 1
    assert sorted(r.page_id for r in A.read(archive).where("verified").collect()) == sorted(x[0] for x in pages)
    assert A.read(archive.where("whole")).count() == 51
    with pytest.raises(Exception, match="ends within a record"):
        A.read(archive.withColumn("data", F.expr("substring(data, 1, length(data) - 30)"))).collect()


def test_empty_archive(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert A.round_trip(none).count() == 0

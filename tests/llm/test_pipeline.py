"""The pipeline's stages on a small corpus: what each must and mustn't remove."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestone.llm.mixing import targets

from .test_quality import labelled


#: Names that the operators use themselves.
ODD = ["id", "_id", "node", "_node", "row", "has_text", "_has_text", "whole_text", "size", "taken", "target", "shard", "slot", "place", "words", "carried", "class", "Kept", "block"]


def tables(spark, tmp_path):
    r = random.Random(5)
    rows = labelled(500, 9)
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, *_ in rows]
    good = [i for i, _, q, t in rows if q and not t]
    copy, near, shared, leak = good[3], good[5], good[7], good[11]
    text = {d[0]: d[1] for d in docs}
    w = text[near].split(" ")
    w[2] = "zzz"
    passage = " ".join("".join(r.choice("abcdeiorst") for _ in range(5)) for _ in range(30))
    bench = " ".join("".join(r.choice("abcdeiorst") for _ in range(6)) for _ in range(14))
    extra = [(1000, text[copy]), (1001, " ".join(w)), (1002, text[shared] + " " + passage), (1003, passage + " " + text[good[9]][::-1]), (1004, text[leak][::-1] + " " + bench.upper()), (1005, None), (1006, "")]
    docs += [(i, t, "en", None, len(t or "")) for i, t in extra]
    docs += [(None, text[good[20]][::-1], None, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({x: F.col("doc_id") * 2 for x in ODD}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, q, t in rows if i % 2], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, rows, good, passage


def test_stages(spark, tmp_path):
    docs, rows, good, passage = tables(spark, tmp_path)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = df.columns, []
    for name, stage in P.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(out := f"{tmp_path}/{name.split()[0]}")
        df = spark.read.parquet(out)
        if name != P.STAGES[-1][0]:
            assert df.columns == columns
        seen.append({r.doc_id: r.text for r in df.collect()})
    quality, near, repeats, clean, mixed = seen
    bad = {i for i, _, q, t in rows if not q or t}
    assert len(bad & set(quality)) <= 0.06 * len(bad) and not {1005, 1006} & set(quality)
    assert len(set(good) & set(quality)) >= 0.97 * len(good)
    assert {1000, 1001} & set(quality) and not {1000, 1001} & set(near)
    assert set(quality) - set(near) <= {1000, 1001, 1002}
    both = [i for i in (1002, 1003) if i in near and passage in near[i]]
    if len(both) == 2:
        assert passage in repeats[1002] and passage not in repeats[1003]
    assert set(repeats) - set(clean) == {1004} & set(repeats)
    assert set(mixed) <= set(clean) and len(mixed) > 50
    assert df.columns == [*columns, "shard_", "slot_", "place_", "words_"]
    assert df.where(" or ".join(f"not {x} <=> doc_id * 2" for x in ODD)).count() == 0


def test_the_mix_has_its_target_words(spark):
    """Sources of 300, 3,000 and 3,000 words with weights 1, 2 and 3: the first comes out three times, the others in parts."""
    docs = [(i, " ".join(f"{i}.{k}" for k in range(300)), "en", "a" if i == 0 else "bc"[i % 2], 7) for i in range(21)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    rows = P.mixing_to_weights(spark, df, "").collect()
    got, order = {}, {x: [d for d in docs if d[3] == x] for x in "abc"}
    for x in rows:
        assert x.text in docs[x.doc_id][1] and x.words == len(x.text.split()) and (x.lang, x.source, x.n_chars) == docs[x.doc_id][2:]
        got[x.source] = got.get(x.source, 0) + len(x.text.split())
    sizes = [300 * len(order[x]) for x in "abc"]
    for x, t in zip("abc", targets(sizes, [1, 2, 3])):
        assert abs(got[x] - t) <= 2 * 128
    assert got["a"] == 900 and len({(x.shard, x.slot, x.place) for x in rows}) == len(rows)


def test_a_very_long_text_and_copies_of_a_row(spark, tmp_path):
    """A text of 2 MB, twice under other ids, and a row twice, come through all stages but quality; one of each is left."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(9000)]
    long_ = " ".join(r.choice(words) for _ in range(300_000))
    short = " ".join(r.choice(words) for _ in range(80))
    docs = [(1, long_, "en", "a", None), (2, long_, "en", "a", None), (3, short, "en", "b", 1), (3, short, "en", "b", 1), (None, None, None, None, None), (4, "", "en", "b", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, words[0])], "item_id bigint, text string").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES[1:4]:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(out := f"{tmp_path}/{stage.__name__}")
        df = spark.read.parquet(out)
    assert sorted((x.doc_id, x.text) for x in df.where("text <> ''").collect()) == [(1, long_), (3, short)]
    rows = P.mixing_to_weights(spark, df, "").collect()
    assert sum(x.words for x in rows if x.source == "b") == 240 and {x.doc_id for x in rows} == {1, 3}


def test_run_on_empty_tables(spark, tmp_path):
    tables(spark, tmp_path / "a")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/a/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    assert P.run(spark, f"{tmp_path}/b").count() == 0

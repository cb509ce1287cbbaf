"""Operators 1, 4 and 10 against plain versions, and their odd cases."""

import random

import pytest

from lodestone.llm.decontaminate import cleaned, decontaminate
from lodestone.llm.substring_dedup import substring_dedup
from lodestone.llm.token_counts import token_counts

from . import brute
from .conftest import rows_of

DOCS = "doc_id bigint, text string, n_words string, chunk int"


def corpus(seed, n=60, vocabulary=9, most=60):
    r = random.Random(seed)
    words = ["a", "bé", "ccc", "d,d", "Ee", "f", "日本", "h h", "i"][:vocabulary]
    passages = [[r.choice(words) for _ in range(r.randint(5, 25))] for _ in range(6)]
    out = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(0, most))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages)
        out.append((i, r.choice([" ", "\n", "  \t"]).join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, out[3][1]), (n + 2, out[3][1]), (None, out[5][1]), (3, out[4][1]), (n + 3, " ".join("xyz" for _ in range(4000)))]


def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS).repartition(3)


@pytest.mark.parametrize("length", [8, 20])
def test_substring_dedup(spark, length):
    docs = corpus(length)
    got = rows_of(substring_dedup(frame(spark, docs), length, full=False, chunk_bytes=700, bucket_bytes=2000))
    assert sorted(got, key=str) == sorted(brute.substring_dedup(docs, length), key=str)


def test_substring_dedup_whole_rows(spark):
    got = {r.doc_id: r for r in substring_dedup(frame(spark, [(1, "a b c d e f"), (2, "x a b c d y")]), 4).collect()}
    assert got[2].kept_text == "x y" and [tuple(s) for s in got[2].removed_spans] == [(1, 5)]
    assert got[1].n_removed == 0


def test_decontaminate(spark):
    docs = corpus(3)
    items = [(k, " ".join(brute.BENCH_WORD.findall(docs[k][1] or "")[:17])) for k in range(0, 30, 4)] + [(90, "日本 F"), (None, "i"), (91, None), (91, "zz top"), (92, "...")]
    bench = spark.createDataFrame([(*x, 5) for x in items], "item_id bigint, text string, doc_id int")
    want = sorted(brute.decontaminate(docs, items, 6), key=str)
    assert sorted(rows_of(decontaminate(frame(spark, docs), bench, 6)), key=str) == want
    assert sorted(rows_of(decontaminate(frame(spark, docs), bench, 6, block_bytes=60)), key=str) == want
    left = {r[0] for r in rows_of(cleaned(frame(spark, docs), bench, 6))}
    assert left == {w[0] for w in want if not w[5]}


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    out = rows_of(cleaned(frame(spark, [(1, "Zero. One, two; THREE four")]), bench, 10, "spans"))
    assert out == [(1, "Zero.  four")]


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = corpus(5) + [(200, "x<|endoftext|>y <|startoftext|>"), (201, "don't WE'LL\u0085éé ́ ÀÉ123\x1cz " * 900), (202, "q" * 5000)]
    t = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in docs]
    assert sorted(rows_of(token_counts(frame(spark, docs), str(P.path("word_bpe_49k.json")))), key=str) == sorted(want, key=str)


def test_token_counts_by_pieces(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    docs = corpus(6, 10) + [(300, "a bc " * 2000)]
    s = sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))
    got = rows_of(token_counts(frame(spark, docs), str(P.path("piece_bpe_32k.model"))))
    assert sorted(got, key=str) == sorted(((i, len((x or "").encode()), n := len(s.encode(x or "")), n > 2048) for i, x in docs), key=str) and any(g[3] for g in got)


def test_token_counts_where_white_space_is_kept(spark):
    """A byte-level tokenizer keeps spaces in its tokens, so texts are encoded whole."""
    P = pytest.importorskip("public_tokenizers")
    from lodestone.llm import token_counts as T

    path = str(P.path("byte_bpe_50k.json"))
    with open(path, "rb") as f:
        t = T.load_json(f.read())
    assert not T.cuts_at_space(t)
    docs = corpus(6, 10) + [(300, "  a  bc\n\n" * 2000), (301, None)]
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in docs]
    assert sorted(rows_of(token_counts(frame(spark, docs), path)), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert substring_dedup(none).count() == 0
    assert decontaminate(none, bench).count() == 0
    assert rows_of(decontaminate(frame(spark, [(1, "a")]), bench))[0][5] is False

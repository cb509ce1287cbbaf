"""Operators on small inputs whose results are known."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalar as S
from lodestone.operators import compare, dedup, intervals, resolve, text


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def ranges(spark, data):
    return spark.createDataFrame([(1, a, b) for a, b in data], "k int, s int, e int")


def test_gaps(spark):
    gaps = lambda data, size, least: [r[1:] for r in rows(intervals.gaps(ranges(spark, data), "k", "s", "e", F.lit(0), F.lit(size), F.lit(least)))]
    assert gaps([(10, 20), (15, 35), (80, 85)], 120, 5) == [(0, 10), (35, 80), (85, 120)]
    assert gaps([(10, 50), (30, 70), (150, 180)], 200, 5) == [(0, 10), (180, 200), (70, 150)]


def test_merged_and_sweep(spark):
    assert rows(intervals.merged(ranges(spark, [(1, 4), (4, 6), (9, 10), (2, 3)]), "k", "s", "e")) == [(1, 1, 6, 3), (1, 9, 10, 1)]
    classed = spark.createDataFrame([(1, 2, 5, 2), (1, 7, 9, 1), (1, 4, 4, 3), (1, 5, 6, 2)], "k int, s int, e int, r int")
    assert rows(intervals.sweep(classed, "k", "s", "e", "r")) == [(1, 2, 6, 2), (1, 6, 7, 0), (1, 7, 9, 1)]


def test_greedy_keeps_by_the_last_kept_row(spark):
    df = ranges(spark, [(0, 5), (3, 100), (6, 8), (7, 9), (8, 9)])
    assert [r[1:] for r in rows(intervals.suppress_overlaps(df, "k", "s", "e", "e"))] == [(0, 5), (6, 8), (8, 9)]


def test_contained_and_as_of(spark):
    points = spark.createDataFrame([(1, 5), (1, 5), (1, 12), (1, 99), (2, 5)], "k int, at int")
    owners = spark.createDataFrame([(1, 0, 10, "a"), (1, 4, 20, "b"), (1, 7, 7, "c")], "k int, s int, e int, owner string")
    assert rows(intervals.contained_in_one(points, owners, "k", "at", "s", "e", "owner", 4)) == [(1, 12, 1, "b"), (1, 5, 2, None), (1, 5, 2, None), (1, 99, 0, None), (2, 5, 0, None)]
    right = spark.createDataFrame([(1, 5, 1.0, 1), (1, 5, 2.0, 2), (1, 11, 3.0, 1)], "k int, at int, v double, tie int")
    assert rows(intervals.as_of(points.distinct(), right, "k", "at", "at", "v", "tie")) == [(1, 12, 3.0, 11), (1, 5, 2.0, 5), (1, 99, 3.0, 11), (2, 5, None, None)]


def test_resolve_never_picks_the_first(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    right = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("d", 9)], "k string, v int")
    assert rows(resolve.resolve(left, right, ["k"], "v")) == [("a", 1, "resolved"), ("b", None, "ambiguous"), ("c", None, "missing"), (None, None, "missing")]


def test_caps_and_names(spark):
    df = spark.createDataFrame([("x", i, i == 4) for i in range(5)] + [("y", 9, False)], "name string, n int, ok boolean")
    assert rows(dedup.cap_with_slots(df, "name", F.col("ok"), ["n"], 2)) == [("x", 0, False), ("x", 4, True), ("y", 9, False)]
    assert [r[3] for r in rows(dedup.unique_suffix(df, "name", ["n"]))] == ["x", "x__2", "x__3", "x__4", "x__5", "y"]
    copies = dedup.content_dedup(spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "i int, t string"), [], F.sha2("t", 256), ["i"])
    assert [(r.i, r.kept.i, r.n_copies, r.is_alias) for r in copies.orderBy("i").collect()] == [(1, 1, 2, False), (2, 1, 2, True), (3, 3, 2, False), (4, 3, 2, True)]


@pytest.mark.parametrize(("a", "b", "same"), [(1.0, 1.0, True), (math.nan, math.nan, False), (math.inf, math.inf, True), (math.inf, -math.inf, False), (1.0, 1.0 + 1e-13, True), (1.0, 1.001, False), (0.0, 5e-13, True)])
def test_tolerance(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert df.select(compare.close(F.col("a"), F.col("b"))).first()[0] is same


def test_pairs(spark):
    df = lambda v: spark.createDataFrame([("b", x) for x in v], "bucket string, v int")
    assert rows(compare.pair_kth(df([1, 2]), df([1]), ["bucket"], ["v"], "v")) == [("b", 1, 1, 1, "both"), ("b", 2, 2, None, "left_only")]


def test_islands_keep_numbers_of_short_runs(spark):
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate([1, 1, 0, 1, 0, 1, 1, None, 1, 1])], "k string, n int, v int")
    assert rows(text.islands(df, "k", ["n"], F.col("v") == 1, 2)) == [("u", 0, 2), ("u", 2, 2), ("u", 3, 2)]


def test_functions(spark):
    names = spark.createDataFrame([("Book_A@2",), ("My_Book_B",), ("X_C@0",), ("plain",), ("X_C@x",)], "n string").select(S.dataset_name(F.col("n")).alias("x")).select("x.*")
    assert [tuple(r) for r in names.collect()] == [("Book", "A", 2), ("My_Book", "B", 1), ("X", "C", None), ("", "plain", 1), ("X", "C", None)]
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(S.column_ordinal(F.lit(x))) for x in ("A", "Z", "AA", "a1")] == [1, 26, 27, None]
    assert value(S.safe_name(F.lit("a b/c"))) == "a_b_c" and value(S.safe_name(F.lit("CON.txt"))) == "_CON.txt" and value(S.safe_name(F.lit(""))) == "item"
    assert value(S.julian_epoch_seconds(F.lit(2440588.0))) == 86400 and value(S.julian_epoch_seconds(F.lit(1.0))) is None
    assert value(S.cell_reference(F.lit("cell://[B]S!a.b"))).asDict() == {"book": "B", "sheet": "S", "parts": ["a", "b"]}
    assert value(S.range_references(F.lit("x [Book1]Sheet1!A + [B]S!C"))) == ["[Book1]Sheet1!A", "[B]S!C"]
    assert value(S.entropy(F.lit("aabb"))) == 1.0
    assert [value(S.note_type(F.lit(x))) for x in ("{\\rtf1", " <HTML>", "<a>", "x", " ")] == ["rtf", "html", "xml", "text", "empty"]
    order = spark.createDataFrame([("a10",), ("a2",), ("A1",)], "n string").orderBy(S.natural_key(F.col("n")))
    assert [r[0] for r in order.collect()] == ["A1", "a2", "a10"]


def test_classes(spark):
    from lodestone.functions import classify as C

    names = spark.createDataFrame([("Graph3",), ("a.XLSX",), ("Matrix1",), ("Spreadsheet",), ("Spread2",), ("__x",), ("foo",), ("f_x",), ("q_x",), ("a.csv",)], "n string")
    assert [r[0] for r in names.select(C.object_kind(F.col("n"))).collect()] == ["graph", "excel", "matrix", "matrix", "matrix", "meta", None, "function", None, None]
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(C.note_payload_type(F.lit(x))) for x in ("", "a <HTML>", "x\n# y", "plain")] == ["unknown_text", "html_like", "markdown_like", "plain_text"]
    assert tuple(value(C.text_issues(F.lit("a\ufffd\x01\n\t\x7f")))) == (1, 2)
    assert [value(C.value_type(F.lit(x).cast("int"))) for x in (0x10, 0x39, 0x34, 0x77, None)] == ["numeric", "text_numeric", "month", "text", "unknown"]
    assert value(C.designation(F.lit(6))) == "XErr"
    kinds = [(n, d, e) for n, d, e in (("A_B", 0, 0), ("x", 0x6081, 0), ("x", 0, 0x4001), ("Matrix", 0, 0), ("x", 0, 0))]
    df = spark.createDataFrame(kinds, "n string, d int, e int")
    assert [r[0] for r in df.select(C.dataset_kind(F.col("n"), F.col("d"), F.col("e"))).collect()] == ["worksheet", "function", "matrix", "matrix", "meta"]
    cells = [("a", 1, " "), ("b", 1, "??"), ("b", 1, "cell://x"), ("d", 1, "x"), ("d", 1, "y")] + [("c", i, "<q>") for i in range(9)] + [("e", i, "<a>") for i in range(8)] + [("e", 8, "1.5")]
    got = dict(tuple(r)[::2] for r in C.content_class(spark.createDataFrame(cells, "t string, r int, v string"), "t", "r", "v").collect())
    assert got == {"a": "empty", "b": "internal_references", "c": "corrupt_text", "d": "data", "e": "data"}

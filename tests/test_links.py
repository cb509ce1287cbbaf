"""Selections, links and reshapes on small rows: nulls, ties and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import intervals, links, reshape, selection, text


def ranges(spark, seed=3, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a = r.randint(0, 300)
        rows.append((r.randint(0, 3), i, a, a + r.choice([0, 1, 5, 30, 90])))
    return rows, spark.createDataFrame(rows, "k int, id int, a int, b int")


def test_greedy_choices(spark):
    rows, df = ranges(spark)
    want_long, want_wide = [], []
    for k in range(4):
        taken = []
        for x in sorted((x for x in rows if x[0] == k), key=lambda x: (x[2] - x[3], x[2], x[1])):
            if all(x[3] <= y[2] or y[3] <= x[2] for y in taken):
                taken.append(x)
        want_long += [x[1] for x in taken if x[3] > x[2]]
        kept = []
        for x in sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[2] - x[3], x[1])):
            hit = [y for y in kept if y[3] > x[2] and y[2] < x[3]]
            if x[3] <= x[2] or any(y[2] <= x[2] and x[3] <= y[3] for y in hit):
                continue
            kept = [y for y in kept if y not in hit] + [x]
        want_wide += [x[1] for x in kept]
    long_ = selection.longest_first(df.where("b > a"), "k", "a", "b", "id")
    assert sorted(r["id"] for r in long_.collect()) == sorted(want_long)
    assert sorted(r["id"] for r in selection.containing_wins(df, "k", "a", "b", "id").collect()) == sorted(want_wide)
    assert selection.longest_first(df.limit(0), "k", "a", "b", "id").count() == 0 and selection.containing_wins(df.limit(0), "k", "a", "b", "id").count() == 0


@pytest.mark.parametrize("width", [7, 64])
def test_owners(spark, width):
    rows, df = ranges(spark)
    marks = [(i, i % 5, i * 4, i * 4 + i % 9) for i in range(80)]
    at = spark.createDataFrame(marks, "p int, k int, at int, till int")
    own = df.withColumn("guess", F.col("id") % 2 == 0)
    first = {r["p"]: r["owner"] for r in links.first_owner(at, own, "k", "p", "at", "a", "b", "id", ["guess"], width).collect()}
    inside = {r["p"] for r in links.inside(at, df, "k", "at", "a", "b", width).collect()}
    outside = {r["p"] for r in links.inside(at, df, "k", "at", "a", "b", width, "left_anti").collect()}
    over = {r["p"]: r["overlaps"] for r in links.overlapping(at, df, "k", "at", "till", "a", "b", width).collect()}
    held = {r["p"]: (r["n_owners"], r["owner"], r["status"]) for r in links.range_owner(at.where("till > at"), own, "k", "p", "at", "till", "a", "b", "id", "guess", width).collect()}
    for p, k, x, y in marks:
        hit = sorted((i % 2 == 0, i) for j, i, a, b in rows if j == k and a <= x < b)
        assert first[p] == (hit[0][1] if hit else None)
        assert (p in inside) == bool(hit) and (p in outside) != bool(hit)
        assert over[p] == any(j == k and x < b and a < y and a < b and x < y for j, i, a, b in rows)
        if y > x:
            whole = [i for j, i, a, b in rows if j == k and a <= x and y <= b]
            good = len(whole) == 1 and whole[0] % 2 == 0
            assert held[p] == (len(whole), whole[0] if good else None, "resolved" if good else "ambiguous" if whole else "missing")


def test_sheet_names(spark):
    sheets = spark.createDataFrame([("A",), ("A_B",), ("C@1",), ("x_y_z",)], "s string")
    cases = {"A_B@2": "A", "A_B": "A", "A@3": "A", "C@1": "C@1", "C@1_q": "C@1", "x_y_z_w": "x_y_z", "none": None, "B_A": None}
    sections = spark.createDataFrame([(x,) for x in cases] + [("A",)], "n string")
    got = {r["n"]: r["worksheet"] for r in links.sheet_of(sections, "n", sheets, "s").collect()}
    assert got == cases | {"A": "A"}


def test_trims_and_shapes(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "x"), (1, 3, "x"), (1, 4, "y"), (1, 5, None), (2, 1, None), (3, 1, "z"), (3, 2, "z")], "k int, at int, v string")
    got = {r["k"]: tuple(r)[1:] for r in reshape.value_shapes(df, "k", "at", "v").collect()}
    assert got == {1: (3, 2, 1, 0), 2: (0, 1, 1, 1), 3: (2, 0, 0, 2)}
    kept = selection.trim_trailing(df, "k", "at", F.col("v").isin("y", "z")).select("k", "at").collect()
    assert sorted(map(tuple, kept)) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1)]
    assert reshape.value_shapes(df.limit(0), "k", "at", "v").count() == 0


def test_unknown_rank_is_an_error(spark):
    df = spark.createDataFrame([(1, 0, 5, 4)], "k int, a int, b int, r int")
    with pytest.raises(Exception, match="rank"):
        intervals.sweep(df, "k", "a", "b", "r").collect()
    assert [tuple(x) for x in intervals.sweep(df, "k", "a", "b", "r", (1, 4)).select("start", "end", "rank").collect()] == [(0, 5, 4)]


def test_paths_and_branches(spark):
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (9, 8, "lost")], "i int, p int, n string")
    assert sorted(tuple(r) for r in reshape.paths(nodes, "i", "p", "n").collect()) == [(1, "a", 0), (2, "a/b", 1), (3, "a/b/c", 2)]
    leaves = spark.createDataFrame([("a/b",), ("a/b",), ("a",), (None,)], "f string")
    assert sorted(tuple(r) for r in reshape.branches(leaves.where("f is not null"), "f").collect()) == [("a", None, 1, 1), ("a/b", "a", 2, 2)]


def test_paths_beyond_the_limits_of_recursion(spark):
    """More rows and more levels than a recursive query may have, cycles, missing parents, repeated and null ids."""
    chain = [(i, i - 1 if i else None, str(i % 7)) for i in range(150)]
    odd = [(1000, 1001, "x"), (1001, 1000, "y"), (1002, 1000, "z"), (1003, 2000, "lost"), (None, None, "root"), (None, 0, "leaf"), (5, 2, "again"), (1004, 1, None), (1005, 1004, "below")]
    nodes = spark.createDataFrame(chain + odd, "i int, p int, n string")
    children = {}
    for i, p, n in chain + odd:
        children.setdefault(p, []).append((i, n))
    want, now = [], [(i, n, 0) for i, n in children[None]]
    while now:
        want += now
        now = [(c, None if path is None or n is None else f"{path}/{n}", d + 1) for i, path, d in now if i is not None for c, n in children.get(i, [])]
    spark.conf.set("spark.sql.cteRecursionRowLimit", "40")
    try:
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in reshape.paths(nodes, "i", "p", "n").collect())
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_paths_into_a_cycle_are_an_error(spark):
    nodes = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (2, 1, "c")], "i int, p int, n string")
    with pytest.raises(ValueError, match="cycle"):
        reshape.paths(nodes, "i", "p", "n")


def test_entropy_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "aabb"), (2, ""), (3, None), (4, "aaaa"), (5, "é" * 3 + "中")], "k int, t string")
    got = {r["k"]: round(r["entropy"], 6) for r in text.char_entropy(df, "k", "t").collect()}
    assert got == {1: 1.0, 4: 0.0, 5: 0.811278}

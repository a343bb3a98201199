"""Small operators against brute force on small inputs."""

import pytest
from pyspark.sql import functions as F

from sheafline.functions import dates
from sheafline.operators import listhead, naming, paging, spots


def test_words_in_span_and_index_against_positions(spark):
    lines = [["one", "two", "a", "three"], [], ["x"]]
    cases = [(i, words, a, b) for i, words in enumerate(lines) for a in range(-2, 18) for b in range(-1, 19)]
    rows = spark.createDataFrame(cases, "i int, words array<string>, a int, b int")
    got = rows.select("words", "a", "b", spots.words_in_span(F.col("words"), F.col("a"), F.col("b")).alias("inside"), spots.word_index_at(F.col("words"), F.col("a")).alias("at")).collect()
    for r in got:
        begins = [sum(len(w) + 1 for w in r.words[:i]) for i in range(len(r.words))]
        assert r.inside == [w for w, c in zip(r.words, begins) if c + len(w) > r.a and c < r.b] or r.a >= r.b, r
        assert r["at"] == next((i for i, c in enumerate(begins) if c >= r.a), len(r.words)), r


def test_steps_to_words(spark):
    steps = [(0, 0.9), (97, 0.5), (97, 0.2), (0, 0.9), (97, 0.8), (32, 0.9), (32, 0.9), (0, 0.1), (32, 0.4), (98, 0.75)]
    rows = spark.createDataFrame([(1, steps), (2, []), (3, [(0, 0.5)])], "i int, s array<struct<code:int,prob:double>>")
    got = {r.i: [(w.text, round(w.conf)) for w in r.w] for r in rows.select("i", spots.steps_to_words(F.col("s")).alias("w")).collect()}
    assert got == {1: [("aa", 50), ("b", 75)], 2: [], 3: []}


def test_nearest_line_takes_the_first_of_ties_and_none_of_nothing(spark):
    rows = spark.createDataFrame([(1, [(0, 10), (20, 30)], 30), (2, [(0, 10), (10, 30)], 60), (3, [], 30)], "i int, l array<struct<y0:int,y1:int>>, h int")
    assert {r.i: r.n and tuple(r.n) for r in rows.select("i", spots.nearest_line(F.col("l"), F.col("h")).alias("n")).collect()} == {1: (0, 10), 2: (10, 30), 3: None}


def test_headers(spark):
    pages = [(1, ["MONTH of Aug ust, 1969"]), (2, ["M0NTH", "MONTH Januarv 1970"]), (3, ["x"] * 6 + ["MONTH May 1969"]), (4, []), (5, None), (6, ["MONTH May 1700 1971"])]
    got = {r.page: (r.month, r.year) for r in listhead.header_month_year(spark.createDataFrame(pages, "page int, lines array<string>"), "page", 2026).collect()}
    assert got == {1: ("aug", 1969), 2: ("jan", None), 3: (None, None), 4: (None, None), 5: (None, None), 6: ("may", 1971)}
    assert listhead.nearest("budgit", ["budget", "widget"]) == "budget" and listhead.nearest("zzz", ["budget"]) is None


def test_dates_as_typed(spark):
    typed = ["1969-02-28", "1969-02", " July 4, 1969 ", "soon", "", None, "1969-13", "1969-02-30"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(typed)], "i int, t string")
    got = rows.orderBy("i").select(dates.norm_date(F.col("t"), 2026).alias("n"), dates.valid_iso(F.col("t")).alias("v")).collect()
    assert [r.n for r in got] == ["1969-02-28", "1969-02", "1969-07-04", "soon", "", None, "1969-13", "1969-02-30"]
    assert [r.v for r in got] == [True, True, False, False, False, False, False, False]


def test_leading_lists_need_a_release_before_and_another_reading(spark):
    rows = [("f", 1, True, True), ("f", 2, False, False), ("f", 3, True, True), ("f", 4, True, False), ("g", 1, True, True), (None, 1, False, True), (None, 2, True, True)]
    got = {(r.f, r.s): r.kind for r in paging.leading_lists(spark.createDataFrame(rows, "f string, s int, is_list boolean, has_release boolean"), "f", "s").collect()}
    assert got == {("f", 1): "list", ("f", 2): "release", ("f", 3): "release", ("f", 4): "list", ("g", 1): "list", (None, 1): "release", (None, 2): "release"}


@pytest.mark.parametrize("bad", [("7", "3", 0, "R{release}", "L"), ("7", "3", 1, "R", "L"), ("7", "3", 1, "R{release}", "R12"), ("7 ", "3", 1, "R{release}", "L"), ("7", "3", 1, "con{release}.x", "a/b"), ("7", "3", 1, "R{number}", "L"), ("7", "3", 1, "R{release}", "")])
def test_namings_that_are_refused(bad):
    with pytest.raises(ValueError):
        naming.check_naming(*bad)


def test_plan_of_files(spark):
    naming.check_naming("7", "3", 1, "B{box} R{release}", "B{box} list")
    pages = spark.createDataFrame([("B7 R1", "a.jpg", 2, 2), ("B7 R1", "a.jpg", 1, 1), ("B7 R2", "b.jpg", 1, 3), ("", "c.jpg", 1, 4), (None, "d.jpg", 1, 5)], "file_name string, file string, page int, ord int")
    there = spark.createDataFrame([("B7 R2",), ("B7 R9",), ("B7 list",), ("other",)], "file_name string")
    ours = naming.owns(F.col("file_name"), "B{box} R{release}", "B{box} list", "7", "3")
    plan = lambda force: {r.file_name: (r.n_pages, r.pages, r.action) for r in naming.write_plan(pages, there, ours, force).collect()}
    assert plan(False) == {"B7 R1": (2, "a.jpg#1 a.jpg#2", "write"), "B7 R2": (1, "b.jpg#1", "leave"), "B7 R9": (0, "", "stale"), "B7 list": (0, "", "stale")}
    assert plan(True)["B7 R2"] == (1, "b.jpg#1", "write")


def test_typed_names_come_first(spark):
    rows = spark.createDataFrame([("t", "j"), ("", "j"), (None, ""), (None, None)], "t string, j string")
    assert [r.n for r in rows.select(naming.typed_first(F.col("t"), F.col("j"), F.lit("d")).alias("n")).collect()] == ["t", "j", "d", "d"]

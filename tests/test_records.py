import pytest
from pyspark.sql import functions as F

from sheafline.operators import quality, records
from sheafline.sources import files


def test_upsert_replaces_only_its_folder_and_is_idempotent(spark):
    schema = "file string, page long, folder string, ord long, v string"
    old = spark.createDataFrame([("a", 1, "f", 0, "old"), ("a", 1, "g", 1, "keep"), ("b", 1, "", 2, "old"), ("c", 1, "f", 3, "keep")], schema)
    new = spark.createDataFrame([("a", 1, "f", 0, "new"), ("b", 1, "f", 1, "new")], schema)
    consumed = new.select("file", "page")
    once = records.upsert(old, new, consumed, "f")
    twice = records.upsert(once, new, consumed, "f")
    expected = [("a", "g", "keep"), ("c", "f", "keep"), ("a", "f", "new"), ("b", "f", "new")]
    assert [(r.file, r.folder, r.v) for r in once.orderBy("ord").collect()] == expected
    assert [(r.file, r.folder, r.v) for r in twice.orderBy("ord").collect()] == expected


def test_results_round_trip(spark, tmp_path):
    cells = ["=SUM(1)", "-dash", "'Tis the season", "''", "plain", "'", 'quote " comma, line\nbreak']
    rows = spark.createDataFrame([(f"{i}.jpg", c) for i, c in enumerate(cells)], "file string, subject string")
    full = rows.select(*[F.col(c).alias(c) if c in rows.columns else F.lit("").alias(c) for c in records.RESULT_COLUMNS])
    path = tmp_path / "results.csv"
    files.write_results(full, str(path))
    assert path.stat().st_mode & 0o777 == 0o600
    back = files.read_results(spark, str(path)).orderBy("file").collect()
    assert [r.subject for r in back] == cells


def test_older_tables_are_adopted(spark):
    old = spark.createDataFrame([tuple("x" * 13)], records.RESULT_COLUMNS[:13])
    assert records.adopt_columns(old).columns == records.RESULT_COLUMNS
    with pytest.raises(ValueError):
        records.adopt_columns(spark.createDataFrame([("x", "y")], ["file", "other"]))


@pytest.mark.parametrize("template, box, folder", [("{release}", "b x", "1"), ("{release}", "1", ""), ("{box}", "1", "1"), ("{nope}{release}", "1", "1"), ("a/{release}", "1", "1"), ("{release}.", "1", "1"), ("con.{release}", "1", "1")])
def test_refused_names(template, box, folder):
    with pytest.raises(ValueError):
        records.name_template(template, box, folder)


def test_names(spark):
    rows = spark.createDataFrame([("f", 3), ("f", 1)], "folder string, seq int")
    named = records.number_releases(rows, "folder", "seq", 7).withColumn("name", records.name_template("B{box}_F{folder}_{release}", "2", "9")).orderBy("seq").collect()
    assert [r.name for r in named] == ["B2_F9_7", "B2_F9_8"]


def test_template_projection(spark):
    rows = spark.createDataFrame([("r1", "", "five words here"), ("", "s", "x"), ("r2", "Subject", "y")], "file_name string, subject string, first_five_words string")
    made = records.project(rows, [("T", "{title}"), ("T", "{file_name}!"), ("N", "")]).collect()
    assert [tuple(r) for r in made] == [("five words here", "r1!", ""), ("Subject", "r2!", "")]
    with pytest.raises(ValueError):
        records.project(rows, [("T", "{nope}")])


def test_quality_rules(spark):
    words = spark.createDataFrame([(1, "entollment", 95.0, True), (1, "seen", 10.0, False), (1, "weak", 50.0, None), (1, "sure", 99.0, None), (1, "denied", 99.0, False)], "day int, word string, conf double, also boolean")
    release = spark.createDataFrame([(1, "enrollment"), (1, "seen"), (1, "photographers")], "day int, word string")
    assert [tuple(r) for r in quality.typos(words, release, ["day"]).collect()] == [(1, "entollment", "enrollment")]
    assert {r.word for r in quality.doubts(words, release, ["day"]).collect()} == {"weak", "denied"}
    known = spark.createDataFrame([("visitors", 4.0), ("pnd", 2.0), ("and", 7.0)], "word string, zipf double")
    asked = spark.createDataFrame([(1, w) for w in ("Visttors", "pnd", "and", "Barsuk", "visitors")], "day int, word string")
    names = spark.createDataFrame([(1, "barsuk")], "day int, word string")
    assert {r.word for r in quality.unknown(asked, names, known, ["day"]).collect()} == {"Visttors", "pnd"}


def test_buckets(spark):
    rows = spark.createDataFrame([("a  b", True, "a b"), ("x", True, "y"), ("x", False, "y"), ("y", False, "y"), ("", True, "y"), ("x", True, "")], "v string, ok boolean, t string")
    assert [r.b for r in rows.select(records.bucket(F.col("v"), F.col("ok"), F.col("t")).alias("b")).collect()] == ["verified_right", "verified_wrong", "flagged_wrong", "flagged_right", "no_answer", None]


def test_inputs_and_units(spark, tmp_path):
    for name in ("b10.jpg", "b2.PDF", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = files.find_inputs(spark, str(tmp_path)).orderBy("sort_key")
    assert [r.path.rsplit("/", 1)[1] for r in found.select("path").collect()] == ["b2.PDF", "b10.jpg"]
    units = files.work_units(found.select("path", F.when(F.lower("path").endswith(".pdf"), 3).alias("n")), F.col("n"))
    assert sorted((r.path[-3:], r.page) for r in units.collect() if r.page) == [("PDF", 1), ("PDF", 2), ("PDF", 3)] and units.count() == 4


def test_failures_are_rows(spark):
    units = spark.createDataFrame([("a",), ("b",)], "file string")
    results = spark.createDataFrame([("a", "no", "")], "file string, needs_review string, review_reasons string")
    got = {r.file: r.needs_review for r in files.with_failures(units, results, ["file"]).collect()}
    assert got == {"a": "no", "b": "YES"}


def test_digitized(spark):
    rows = spark.createDataFrame([("D:20200102030405", None, None), (None, "2019:05:06 07:08:09", None), ("junk", "junk", "2018:01:01 00:00:00"), (None, None, None)], "p string, o string, e string")
    got = rows.select(files.digitized_date(F.col("p"), F.col("o"), F.col("e"), F.to_timestamp(F.lit("2017-03-04 00:00:00"))).alias("d")).collect()
    assert [r.d for r in got] == ["2020-01-02", "2019-05-06", "2018-01-01", "2017-03-04"]


def test_reader_interface(spark):
    from sheafline.runtime import ship
    from sheafline.sources.readers import read_pages

    class Fake:
        name = "fake"

        def read(self, content):
            if content == b"bad":
                raise ValueError
            return [(0, i, w, 99.0, 0, 0, 1, 1) for i, w in enumerate(content.decode().split())]

    ship(spark)
    pages = spark.createDataFrame([("a", bytearray(b"one two")), ("b", bytearray(b"bad"))], "page_key string, content binary")
    assert [(r.page_key, r.text) for r in read_pages(pages, Fake()).collect()] == [("a", "one"), ("a", "two")]

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafline.functions import dates, text


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "line, iso, flag",
    [
        ("May 3 , 1987", "1987-05-03", None), ("le 14 mars 1992", "1992-03-14", None), ("14 de marzo de 1992", "1992-03-14", None), ("3. Mai 1987", "1987-05-03", None),
        ("5/3/87", "1987-05-03", "US month/day"), ("25/3/1987", "1987-03-25", "day/month"), ("May 1987", "1987-05", "no day"), ("1. März 1970", "1970-03-01", None),
        ("12 février 1999", "1999-02-12", None), ("Sept. 9, '69", "1969-09-09", "two-digit year"), ("Jan 1, 1800", "1800-01-01", "plausible"),
    ],
)
def test_dates(spark, line, iso, flag):
    found = one(spark, line, lambda c: dates.parse_dates(c, 2026))
    assert [f.iso for f in found] == [iso]
    assert any(flag in f for f in found[0].flags) if flag else not found[0].flags


@pytest.mark.parametrize("line", ["February 30, 1987", "no date", "", "13/13/1999"])
def test_no_dates(spark, line):
    assert one(spark, line, lambda c: dates.parse_dates(c, 2026)) == []


def test_several_dates_in_order_of_place(spark):
    found = one(spark, "from 1987-05-03 to May 9, 1988", lambda c: dates.parse_dates(c, 2026))
    assert [f.iso for f in found] == ["1987-05-03", "1988-05-09"]


@pytest.mark.parametrize("token, clean", [("today.", "today"), ("Dr.", "Dr."), ("U.S.", "U.S."), ("(ABC)", "ABC"), ("'t", "'t"), ("J.", "J."), ("“So,”", "So")])
def test_clean_word(spark, token, clean):
    assert one(spark, token, text.clean_word) == clean


@pytest.mark.parametrize(
    "words, lang, removed, head",
    [
        ("L'université a annoncé", "fr", 0, "université"), ("'t Huis", "nl", 1, "Huis"), ("I am", "en", 0, "I"), ('"A special showing', "en", 1, '"special'),
        ("The the house", "en", 2, "house"), ("the", "en", 1, None), ("Les l'un x", "fr", 2, "x"),
    ],
)
def test_articles(spark, words, lang, removed, head):
    made = one(spark, words, lambda c: text.strip_articles(F.split(c, " "), text.word_map(text.ARTICLES, F.lit(lang)), text.word_map(text.ELIDED, F.lit(lang))))
    assert (made.removed, made.head) == (removed, head)


@pytest.mark.parametrize("word, upper", [('"special', '"Special'), ("iPhone", "IPhone"), ("123", "123"), ("", "")])
def test_capitalize(spark, word, upper):
    assert one(spark, word, text.capitalize_first) == upper


def test_natural_order(spark):
    names = ["release10", "Release3", "0100", "release2", "0020", "release1"]
    frame = spark.createDataFrame([(n,) for n in names], "x string").orderBy(text.natural_key(F.col("x")))
    assert [r.x for r in frame.collect()] == ["0020", "0100", "release1", "release2", "Release3", "release10"]


@pytest.mark.parametrize("subject, cut", [("Manage-", True), ("(Jan.", True), ('He said "no', True), ("a -- b", False), ("end --", False), ("plain", False)])
def test_unfinished(spark, subject, cut):
    assert one(spark, subject, text.is_unfinished) is cut


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="=+-@'ab ", max_size=6), min_size=1, max_size=20))
def test_cells_round_trip(spark, cells):
    frame = spark.createDataFrame([(c,) for c in cells], "x string")
    assert frame.where(text.plain_cell(text.safe_cell(F.col("x"))) != F.col("x")).count() == 0


def test_tokens_and_parts(spark):
    assert one(spark, "The co-op's new Additions to class", text.subject_tokens) == ["coop", "addition", "class"]
    assert one(spark, "reception-Ellingson/Hall", text.word_parts) == ["reception", "ellingson", "hall"]
    assert one(spark, "Aé 9ß", text.mask) == "Xx 9x"
    assert one(spark, "ab°c™", text.strays) == "° ™"


def test_compounds(spark):
    assert one(spark, "Tie-Up", text.compounds) == {}  # "up" is too short to be a token
    assert one(spark, "Library-Fund Drive, library-fund", text.compounds) == {"libraryfund": ["library", "fund"]}
    assert one(spark, "transportation-distribution plan", text.release_tokens) == ["transportationdistribution", "plan", "transportation", "distribution"]


def test_release_date_of_a_page(spark):
    """The cue's line and the one after it, then the dateline, then any; other dates are told; no page's lines are dealt or joined."""
    made = lambda *lines: [(t, False, [("iso", d, d, []) for d in ds]) for t, ds in lines]
    pages = [
        (0, made(("1 May", ["1987-05-01"]), ("For release", []), ("3 May", ["1987-05-03", "1987-05-02"]), ("1 May", ["1987-05-01"]))),
        (1, [("a", False, [("iso", "d", "1987-05-01", ["old"])]), ("b", True, [("iso", "d", "1987-05-02", ["new"])])]),
        (2, made(("x", ["1987-05"]), (None, []), ("y", []))), (3, made(("Release", []))), (4, []), (5, None), (6, [("x", None, None), ("y", None, [("iso", "d", "1987", [])])]),
    ]
    frame = spark.createDataFrame(pages, f"page long, lines array<struct<text:string,is_dateline:boolean,dates:{dates.FOUND}>>")
    found = dates.pick_release_date(frame).select("page", "iso", "flags")
    none, others = ["no date found above the article body"], "other dates also found above the body: "
    assert [tuple(r)[1:] for r in found.orderBy("page").collect()] == [
        ("1987-05-03", [f"{others}1987-05-01, 1987-05-02"]), ("1987-05-02", ["new", f"{others}1987-05-01"]), ("1987-05", []), (None, none), (None, none), (None, None), ("1987", []),
    ]


def test_release_dates_need_no_join(spark, tmp_path):
    """Neither a broadcast, which the driver would hold whole, nor a shuffle; repeated keys and null dates as in the SQL."""
    from datetime import datetime

    from compare import duck, rows_of
    from sheafline.plans import scalars

    rows = [(k, datetime(1995, 1 + k % 12, 28)) for k in (0, 1, 2, 3, 4, 5, 6, 7, 7)] + [(k, None) for k in (8, 9, 10, 11)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "o"))
    next((tmp_path / "o").glob("*.parquet")).rename(tmp_path / "orders.parquet")
    made = scalars.pick_release_date(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Broadcast", "Exchange", "Join", "Window"))
    assert rows_of(made.toPandas()) == rows_of(duck(scalars.PICK_SQL, str(tmp_path)))


@pytest.mark.parametrize("word, upper", [("ßen", "ẞen"), ("«ßen", "«ẞen"), ("ŉa", "ŉa"), ("ᾳb", "ᾼb"), ("ᾲ", "ᾲ"), ("ﬁn", "ﬁn"), ("ƛa", "ƛa"), ("ǆa", "Ǆa"), ("éa", "Éa"), ("ab", "Ab")])
def test_a_capital_is_one_letter(spark, word, upper):
    assert one(spark, word, text.capitalize_first) == upper


def test_opening_equals_sql_for_odd_letters(spark, tmp_path):
    """Letters whose case mapping has several characters or depends on what follows: after an article and in one."""
    from compare import duck, rows_of
    from sheafline.plans import scalars

    texts = [(t.format(c), lang) for c in text.ODD_LETTERS + "İΣςıǅ" for t, lang in (("Das {0}b c d e f", "de"), ("{0}l {0}b b c d e f", "it"), ("{0} ΤΗ{0} a b c d e", "el"), ("the {0}nc. {0}. b", "en"))]
    docs = [(i, *t) for i, t in enumerate([*texts, ("ΤΗΣ Αγοράς a b c d", "el"), ("L'İstanbul a b c d", "fr")])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert rows_of(scalars.first_five_words(spark, str(tmp_path)).toPandas()) == rows_of(duck(scalars.FIVE_SQL, str(tmp_path)))

import pytest
from pyspark.sql import functions as F

from sheafline.operators import voting

READERS = ["tesseract", "easyocr", "doctr", "other"]
SCHEMA = "readings array<struct<reader:string,texts:array<string>,confs:array<double>,flags:array<string>>>"


def vote(spark, *texts, conf=99.0, flags=None):
    readings = [(READERS[i], t.split(), [conf] * len(t.split()), (flags or {}).get(i, [])) for i, t in enumerate(texts)]
    return voting.reconcile_words(spark.createDataFrame([(readings,)], SCHEMA)).select("verified", "value", "confidence", "reasons").first()


@pytest.mark.parametrize(
    "texts, verified",
    [
        (("a b", "a b", "x"), True), (("a b", "a c", ""), False), (("a b", "a b", "", ""), False), (("x y", "a b", "a b"), False), (("", "a b", "a b"), False),
        (("a b", "a b"), True), (("a b", "a c"), False), (("a b",), False), (("", "", ""), False),
    ],
)
def test_majority(spark, texts, verified):
    assert vote(spark, *texts).verified is verified


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("John Smith, (A.B.C.)", "John Smith (ABC)", True), ("a, b", "a; b", False), ("a b", "a, b", False), ("Will", "will", False), ("Technology's", "Technology", False), ("a..", "a.", True), ("a.", "a..", False),
    ],
)
def test_punctuation_rule(spark, a, b, same):
    frame = spark.createDataFrame([(a.split(), b.split())], "a array<string>, b array<string>")
    assert frame.select(voting.same_words(F.col("a"), F.col("b")).alias("s")).first().s is same


def test_confidence_floor(spark):
    assert vote(spark, "a", "a", "a", conf=85.0).reasons == []
    assert any("< 90" in r for r in vote(spark, "a", "a", conf=85.0).reasons)
    assert any("< 90" in r for r in vote(spark, "a", "a", "a", "b", conf=85.0).reasons)
    assert any("< 80" in r for r in vote(spark, "a", "a", "a", conf=75.0).reasons)


def test_reasons_and_value(spark):
    made = vote(spark, "", "a b", "a c")
    assert made.value == "a b" and made.confidence == 0.0
    assert "first words only read by easyocr" in made.reasons and any("vs doctr 'a c'" in r for r in made.reasons)
    assert vote(spark, "", "").reasons == ["no article words found"]


def test_flags_of_all_are_told_once(spark):
    made = vote(spark, "a", "a", "b", flags={0: ["stain", "fold"], 1: ["stain"]})
    assert made.reasons[:2] == ["stain", "tesseract: fold"]


def test_agreement_settles_a_place_found_by_position(spark):
    assert vote(spark, "a b", "a b", flags={1: [voting.SETTLED, "small"]}).reasons == ["easyocr: small"]
    assert vote(spark, "a b", "a b", flags={0: [voting.SETTLED]}).reasons == [f"tesseract: {voting.SETTLED}"]
    assert f"easyocr: {voting.SETTLED}" in vote(spark, "a b", "a c", flags={1: [voting.SETTLED]}).reasons


def test_vote_equals_sql_for_odd_letters(spark, tmp_path):
    """Openings whose first letter has a capital of several characters, under every habit of the three readers."""
    from compare import duck, rows_of
    from sheafline.plans import votes

    texts = ["der ßen b, c. d e f", "das ßßen b c d e", "die ß b. c d e", "ein ŉab, c d", "der ﬁn b", "the ßb's (ABC) c; d. e", "ßab c d e f"]
    docs = [(i, texts[i % len(texts)], "en" if i % len(texts) == 5 else "de") for i in range(420)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert rows_of(votes.vote_words(spark, str(tmp_path)).toPandas()) == rows_of(duck(votes.VOTE_SQL, str(tmp_path)))


def test_vote_equals_sql_for_odd_rows(spark, tmp_path):
    """No text or language, elisions in a row, spaces and line separators on which patterns differ, new letters."""
    from compare import duck, rows_of
    from sheafline.plans import votes

    texts = [
        (None, "en"), ("", "en"), (None, None), ("the house of l'amour b c", None), ("der Hund b c d e", "xx"), ("L'l’amour b c d. e", "fr"), ("l'un'l'\"amour b c d e", "it"), ("l'l'la b c d e f", "fr"),
        ("lʼlʼamour b c d e", "fr"), ("lʼʼab l'b c d e", "ca"), ("the\x0bend a\x0bb c d e f", "en"), ("the end.\u2028 (b).\u0085 Dr.\u2029 d, e", "en"), ("a.\u2028 b.\u2028 c d e f", "xx"),
        ("the \U00031350a \u0870. \U00016ac0 d e f", "en"), ("l'\ua7d1a b c d e", "fr"), ("\U00031350", "en"),
    ]
    docs = [(i, *texts[i % len(texts)]) for i in range(-160, 1680)] + [(None, "the end b c d e", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert rows_of(votes.vote_words(spark, str(tmp_path)).toPandas()) == rows_of(duck(votes.VOTE_SQL, str(tmp_path)))

import itertools

import pytest
from pyspark.sql import functions as F

from sheafline.operators import listing, matching, paging

FIELDS = "folder long, seq long, starts boolean, cont boolean, more boolean, ends boolean"


@pytest.mark.parametrize("line, cont", [("2", True), ("Page 2", True), ("- 2 -", True), ("add ~- 2", True), ("(continued)", True), ("News --add 1--", True), ("Page 1", False), ("text", False)])
def test_continuation(spark, line, cont):
    assert spark.createDataFrame([(line,)], "x string").select(paging.continues(F.col("x"), F.lit(False)).alias("c")).first().c is cont


@pytest.mark.parametrize("line, more, ends", [("-more-", True, False), ("(MORE)", True, False), ("=nore=", True, False), ("-30-", False, True), ("###", False, True), ("# # #", False, True), ("more of it", False, False)])
def test_end_marks(spark, line, more, ends):
    row = spark.createDataFrame([(line,)], "x string").select(paging.goes_on(F.col("x")).alias("m"), paging.ends(F.col("x")).alias("e")).first()
    assert (row.m, row.e) == (more, ends)


def fold(pages):
    """A fresh model of the grouping without slugs: releases as lists of page numbers."""
    groups = []
    for i, (starts, cont, _, _) in enumerate(pages):
        before = pages[i - 1] if i else None
        new = not groups or (not cont and (starts or (not before[2] and before[3])))
        groups.append([i]) if new else groups[-1].append(i)
    return [n for n, g in enumerate(groups, 1) for _ in g]


def test_grouping_equals_a_fold(spark):
    cues = list(itertools.product([True, False], repeat=4))
    folders = list(itertools.product(cues, repeat=2)) + [(a, b, c) for a, b, c in zip(cues, cues[3:] + cues[:3], cues[7:] + cues[:7])]
    rows = [(f, i, *p) for f, pages in enumerate(folders) for i, p in enumerate(pages)]
    got = paging.group_in_order(spark.createDataFrame(rows, FIELDS)).orderBy("folder", "seq").collect()
    assert [r.release_id for r in got] == [n for pages in folders for n in fold(pages)]


def test_slug_rule(spark):
    rows = [
        (1, 0, True, False, False, False, [], ["library", "gift"]), (1, 1, False, True, False, False, ["library"], ["more"]), (1, 2, False, True, False, False, ["tennis"], ["match"]),
        (2, 0, True, False, True, False, [], ["library"]), (2, 1, False, True, False, False, ["tennis"], ["x"]),
    ]
    got = paging.group_with_slugs(spark.createDataFrame(rows, FIELDS + ", tag array<string>, words array<string>")).orderBy("folder", "seq").collect()
    assert [r.release_id for r in got] == [1, 1, 2, 1, 1] and got[2].flag == paging.OTHER_SLUG


def test_a_denied_more_is_told_on_both_sides(spark):
    rows = [(1, 0, True, False, False, False), (1, 1, False, False, True, False), (1, 2, True, False, True, False), (1, 3, False, True, False, False), (2, 0, True, False, True, False)]
    expected = ["", f"{paging.ASSUMED} | {paging.MORE_DENIED}", paging.MORE_DENIED, "", ""]
    plain = paging.group_in_order(spark.createDataFrame(rows, FIELDS)).orderBy("folder", "seq").collect()
    slugs = paging.group_with_slugs(spark.createDataFrame([(*r, [], []) for r in rows], FIELDS + ", tag array<string>, words array<string>")).orderBy("folder", "seq").collect()
    assert [r.flag for r in plain] == [r.flag for r in slugs] == expected and [r.release_id for r in slugs] == [1, 1, 2, 2, 1]


def test_list_dates(spark):
    rows = [(1, 1, "1970-11-09"), (1, 2, None), (1, 3, "1970-11-08"), (1, 4, "1970-11-10"), (2, 1, None)]
    frame = spark.createDataFrame(rows, "folder int, n int, d string").withColumn("date", F.to_date("d"))
    got = listing.fill_dates(frame, "folder", ["n"]).orderBy("folder", "n").collect()
    assert [str(r.final_date) for r in got] == ["1970-11-09", "1970-11-09", "1970-11-08", "1970-11-10", "None"]
    assert [bool(r.flag) for r in got] == [False, False, True, False, False]


@pytest.mark.parametrize("raw, clean", [("° Unique", "Unique"), ("Davidson NTID -", "Davidson NTID"), ("| Gift ] of books", "Gift of books"), ('"Quoted" (x).', '"Quoted" (x).')])
def test_tidy(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "x string").select(listing.tidy(F.col("x")).alias("t")).first().t == clean


def test_near_months_and_days(spark):
    made = spark.createDataFrame([("Nuv", "1O"), ("Dec", "l2"), ("xyz", "99")], "m string, d string").select(listing.near_month(F.col("m")).alias("m"), listing.lookalike_day(F.col("d")).alias("d")).collect()
    assert [(r.m, r.d) for r in made] == [("nov", 10), ("dec", 12), (None, None)]


def day_match(entries, releases):
    import numpy as np

    tokens = [e.lower().split() for e in entries]
    df = {t: sum(t in set(x) for x in tokens) for x in tokens for t in x}
    idf = {t: float(np.log((len(tokens) + 1) / (c + 0.5))) for t, c in df.items()}
    table = np.array([[matching.fuzzy_score(t, idf, set(r.lower().split())) for t in tokens] for r in releases])
    return matching.settle_day(table, releases)


def test_day_matching():
    entries = ["Kolb honored", "library gift", "tennis season", "print show", "chemistry grant"]
    releases = ["a gift to the library made", "chemistry gets a grant", "Kolb is honored", "tennls season begins", "a show of prints and print"]
    made = day_match(entries, releases)
    assert [m["entry"] for m in made] == [1, 4, 0, 2, 3] and all(m["confident"] for m in made)
    twins = day_match(["football game", "football game"], ["the football game won"])
    assert twins[0]["entry"] is None and twins[0]["candidates"] == [0, 1]
    shared = day_match(["hometown students named", "other thing"], ["hometown students named in Avon", "hometown students named around Buffalo area schools", "hometown students named: three in Chili"])
    assert all(m["shared"] and m["entry"] == 0 for m in shared)
    copies = day_match(["hometown students", "other thing"], ["hometown students named"] * 2)
    assert all(m["duplicate"] and not m["shared"] for m in copies)


def test_assignment_is_optimal():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (2, 4), (4, 2), (5, 5), (3, 6)):
        score = rng.random((n, m))
        pairs = matching.assign(score)
        small, large = min(n, m), max(n, m)
        options = [sum(score[i, p[i]] if n <= m else score[p[i], i] for i in range(small)) for p in itertools.permutations(range(large), small)]
        assert len(pairs) == small and abs(sum(score[i, j] for i, j in pairs) - max(options)) < 1e-9

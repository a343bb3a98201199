"""Page cues and the grouping of pages in scan order into releases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lines looked at, and the longest line that holds a header date.
HEAD, FOOT, HEADER_DATE_WORDS = 8, 3, 7
# Patterns of page cues.
CONTINUED = r"(?i)\(?\bcont(?:inued|'d)\b\)?"
ADD = r"(?i)\badd\W{0,4}([0-9lI]{1,2})\b"
LONE_NUMBER = r"(?i)^\W*(?:page\s*)?(\d{1,2})\W*$"
PAGE_NUMBERS = (r"(?i)\bpage\s+(\d{1,2})\b", r"(?:^|\s)[-–—_~]+\s*(\d{1,2})\s*[-–—_~]?\s*$")
MORE = r"(?i)^[\W_]*\(?\s*[mn]ore\s*\)?[\W_]*$"

FIRST_MISSING = "the first page looks like a continuation (page number or 'continued' at the top); the start of its release is missing"
BOTH = "a page has both a date or release line and a page number; joined to the release before it"
MORE_DENIED = "the page before ended '-more-' but the next page begins a new release; check the pages"
NO_HEADER = "no release header, date or page number found; treated as a new release"
ASSUMED = "a page with no header, date or page number was assumed to be a continuation of the release before it; check the pages"
OTHER_SLUG = "a page's slug does not fit the release before it; treated as a new release"


def number_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.try_to_number(F.regexp_extract(text, pattern, 1), F.lit("99")).cast("int"), F.lit(0))


def continues(text: Column, letterhead: Column) -> Column:
    """A page number of two or more, an "add" count or "continued"; a lone number doesn't count under a letterhead."""
    added = F.translate(F.regexp_extract(text, ADD, 1), "lI", "11")
    numbered = (number_of(text, LONE_NUMBER) >= 2) & ~letterhead
    for pattern in PAGE_NUMBERS:
        numbered = numbered | (number_of(text, pattern) >= 2)
    return text.rlike(CONTINUED) | (F.coalesce(F.try_to_number(added, F.lit("99")).cast("int"), F.lit(0)) >= 1) | numbered


def ends(text: Column) -> Column:
    core = F.lower(F.regexp_replace(text, r"[\s*\-–—_~]", ""))
    return core.isin("30", "end", "ends") | core.rlike("^#{3,}$")


def goes_on(text: Column) -> Column:
    return text.rlike(MORE)


def group_in_order(pages: DataFrame, folder: str = "folder", seq: str = "seq") -> DataFrame:
    """pages(folder, seq, starts, cont, more, ends) -> with release_id from 1 and flag, the page's notes with " | " between:
    a window over the scan order.  That a release said to go on but didn't is told on both sides."""
    order = Window.partitionBy(folder).orderBy(seq)
    before = lambda c: F.coalesce(F.lag(c).over(order), F.lit(False))
    marked = pages.withColumns({"__more": before("more"), "__ends": before("ends"), "__first": F.row_number().over(order) == 1})
    fresh = F.col("starts") & ~F.col("cont")
    bare = ~F.col("starts") & ~F.col("cont")
    new = F.col("__first") | fresh | (bare & ~F.col("__more") & F.col("__ends"))
    flag = (
        F.when(F.col("__first"), F.when(F.col("cont") & ~F.col("starts"), FIRST_MISSING))
        .when(F.col("cont") & F.col("starts"), BOTH).when(fresh & F.col("__more"), MORE_DENIED)
        .when(bare & ~F.col("__more"), F.when(F.col("__ends"), NO_HEADER).otherwise(ASSUMED))
    )
    denied = F.when(F.col("more") & F.coalesce(F.lead(fresh).over(order), F.lit(False)), MORE_DENIED)
    return marked.withColumns({"release_id": F.sum(new.cast("int")).over(order), "flag": F.concat_ws(" | ", flag, denied)}).drop("__more", "__ends", "__first")


GROUPED = "folder long, seq long, release_id int, flag string"


def group_with_slugs(pages: DataFrame) -> DataFrame:
    """pages(folder, seq, starts, cont, more, ends, tag, words): as group_in_order, and a later page whose slug shares
    no word with its release so far begins a new one.  The vocabulary is a fold, so pages of a folder come sorted as a
    stream; a folder needs the memory of one release's vocabulary.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["folder", "seq", "release_id", "flag"]
        folder, number, vocabulary, previous = object(), 0, set(), None
        held: tuple | None = None  # the page before: the next one may add a note to it
        for frame in frames:
            out = []
            for p in frame.itertuples(index=False):
                tag, mine = set(p.tag), set(p.words)
                if p.folder != folder:
                    folder, number, vocabulary, previous = p.folder, 0, set(), None
                flag, new = "", previous is None
                if previous is not None and tag and not tag & vocabulary and not p.starts and not previous.more:
                    new, flag, vocabulary = True, OTHER_SLUG, set()
                elif previous is None:
                    flag = FIRST_MISSING if p.cont and not p.starts else ""
                elif p.cont:
                    flag = BOTH if p.starts else ""
                elif p.starts:
                    new, flag, vocabulary = True, MORE_DENIED if previous.more else "", set()
                    held = (*held[:3], " | ".join(filter(None, (held[3], flag))))
                elif not previous.more:
                    new = bool(previous.ends)
                    flag = NO_HEADER if previous.ends else ASSUMED
                vocabulary |= mine
                number += new
                out += [held] if held else []
                held, previous = (p.folder, p.seq, number, flag), p
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([held] if held else [], columns=columns)

    sorted_pages = pages.repartition("folder").sortWithinPartitions("folder", "seq")
    return sorted_pages.select("folder", "seq", "starts", "cont", "more", "ends", "tag", "words").mapInPandas(run, GROUPED)


# The narrowest page that reads well, and how far a language has to lead to be read instead of English.
LEAST_WIDTH, LEAST_LEAD = 1500, 2.0


def low_resolution(width: Column) -> Column:
    """A reason for narrow pages, else null."""
    return F.when(width < LEAST_WIDTH, F.concat(F.lit("low-resolution page ("), width.cast("string"), F.lit("px wide); a closer photo would be more reliable")))


def reading_language(detected: Column, lead: Column, known: list[str]) -> tuple[Column, Column]:
    """The language to read in, English unless a known one leads clearly, and a reason where one leads weakly."""
    other = (F.coalesce(detected, F.lit("")) != "") & (detected != "en")
    clear = other & (lead >= LEAST_LEAD) & detected.isin(known)
    doubt = F.concat(F.lit("text may be non-English (weak signal for '"), detected, F.lit("'); read as English"))
    return F.when(clear, detected).otherwise(F.lit("en")), F.when(other & ~clear, doubt)


def leading_lists(pages: DataFrame, file: str, seq: str) -> DataFrame:
    """pages(file, seq, is_list, has_release) -> with kind.  Lists come before the releases of a file: a page taken for
    one after a release is the release that its other reading shows, if it has one."""
    before = Window.partitionBy(file).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    late = F.coalesce(F.max(~F.col("is_list")).over(before), F.lit(False))
    return pages.withColumn("kind", F.when(F.col("is_list") & ~(late & F.col("has_release")), "list").otherwise("release"))

"""The heading of a list page: month and year, also through misread words."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import EARLIEST_YEAR, MONTH_NAMES
from ..functions.text import letters_only

# Lines of a heading, the word that announces the month, and how near a reading has to come.
HEAD_LINES, ANNOUNCED, NEAR_ANNOUNCED, NEAR_MONTH, NEAR_ANY = 6, "month", 0.7, 0.8, 0.75
MONTHS = MONTH_NAMES["en"].split()


def nearest(word: str, targets: list[str], least: float = NEAR_ANY) -> str | None:
    """The target most like a word, or null if none is like enough."""
    return next(iter(difflib.get_close_matches(word, targets, 1, least)), None)


def header_month_year(pages: DataFrame, page: str, today_year: int) -> DataFrame:
    """pages(page, lines array<string>) -> page, month (three letters) and year, null where not told.

    The line that begins with the word MONTH, or what is left of it, is looked for in the first six; the word may be
    misread, and the month's name misread or broken in two.  A year comes of the first such line only, a month of the
    first one that shows any.  Python sees no more than those six lines of a page.
    """
    kind = pages.schema[page].dataType.simpleString()

    def read(tokens: list[list[str]], years: list[list[str]]) -> tuple[str | None, int | None]:
        at = [i for i, t in enumerate(tokens) if len(t) and nearest(t[0], [ANNOUNCED], NEAR_ANNOUNCED)]
        told = (nearest(w, MONTHS, NEAR_MONTH) for i in at for rest in [list(tokens[i][1:])] for w in [*rest, *map("".join, zip(rest, rest[1:]))])
        month = next(filter(None, told), None)
        possible = [int(y) for i in at[:1] for y in years[i] if EARLIEST_YEAR <= int(y) <= today_year]
        return month and month[:3], possible[0] if possible else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [read(t, y) for t, y in zip(frame.tokens, frame.years)]
            out = pd.DataFrame({page: frame[page], "month": [m for m, _ in found], "year": pd.array([y for _, y in found], dtype="Int32")})
            yield out

    head = F.slice(F.coalesce("lines", F.array().cast("array<string>")), 1, HEAD_LINES)
    tokens = F.transform(head, lambda t: F.array_remove(F.split(letters_only(t), " "), ""))
    years = F.transform(head, lambda t: F.regexp_extract_all(t, F.lit(r"(?<![\p{L}\p{N}_])(\d{4})(?![\p{L}\p{N}_])"), F.lit(1)))
    return pages.select(page, tokens.alias("tokens"), years.alias("years")).mapInPandas(run, f"{page} {kind}, month string, year int")

"""List pages: rows of a date and a subject, repaired, dated and joined where they wrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Month abbreviations and the pattern of a row that begins with a month and a day.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ROW = r"^[\W_]*([A-Za-z]{3,5})\W{0,6}([0-9A-Za-z]{1,2})(?![0-9A-Za-z])(?:\W{0,3}([0-9:]{3,5})(?![A-Za-z0-9]))?(.*)$"
LOOKALIKES = ("OoIlSsBb", "00115588")
LIST_ROWS, LIST_SHARE, ORDER_SHARE = 5, 0.6, 0.8


def lookalike_day(token: Column) -> Column:
    """A day from 1 to 31 whose digits may be read as letters; null if it is none."""
    day = F.translate(token, *LOOKALIKES)
    number = F.when(day.rlike("^[0-9]{1,2}$"), day.cast("int"))
    return F.when(number.between(1, 31), number)


def near_month(token: Column) -> Column:
    """The first month abbreviation that is the token or differs from it in one letter."""
    t = F.substr(F.lower(token), F.lit(1), F.lit(3))
    off = lambda m: F.size(F.filter(F.zip_with(F.split(t, ""), F.split(m, ""), lambda a, b: a != b), lambda d: d))
    names = F.array(*map(F.lit, MONTHS))
    return F.when(F.array_contains(names, t), t).otherwise(F.get(F.filter(names, lambda m: (F.length(t) == 3) & (off(m) == 1)), F.lit(0)))


def month_of(token: Column, page_month: Column) -> Column:
    """The page's month if the token is within a letter of it, else a cleanly printed month."""
    t = F.substr(F.lower(token), F.lit(1), F.lit(3))
    off = F.size(F.filter(F.zip_with(F.split(t, ""), F.split(page_month, ""), lambda a, b: a != b), lambda d: d))
    return F.when((F.length(t) == 3) & (off == 1), page_month).when(t.isin(MONTHS), t)


def tidy(subject: Column) -> Column:
    """Rulings, specks and stray dashes off the edges; quotes, brackets and a closing full stop stay."""
    out = F.regexp_replace(subject, r"\s*[|\[\]{}]\s*", " ")
    out = F.regexp_replace(F.regexp_replace(out, "^[ _~‘'`]+", ""), "[ _~‘'`]+$", "")
    out = F.regexp_replace(out, r"^[^\p{L}\p{N}_\"“(\[]+\s", "")
    out = F.regexp_replace(out, r"\s[^\p{L}\p{N}_\"”)\].!?]+$", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def parse_rows(rows: DataFrame, text: str = "text", page_month: str = "month") -> DataFrame:
    """Adds abbr, day, year_raw, subject and flags to rows of a list page."""
    got = lambda g: F.regexp_extract(F.col(text), ROW, g)
    mon, raw = got(1), got(2)
    abbr = F.when(mon != "", month_of(mon, F.col(page_month)))
    day = lookalike_day(raw)
    cap = F.initcap(abbr)
    flags = F.array_compact(F.array(
        F.when(abbr.isNull(), F.lit("no date printed; assumed same day as the entry above")),
        F.when(mon != cap, F.concat(F.lit("month read as '"), mon, F.lit("'; taken as "), cap)),
        F.when(abbr.isNotNull() & day.isNull(), F.concat(F.lit("day unreadable ('"), raw, F.lit("'); assumed same day as the entry above"))),
        F.when(abbr.isNotNull() & day.isNotNull() & ~raw.rlike("^[0-9]+$"), F.concat(F.lit("day read as '"), raw, F.lit("'; taken as "), day.cast("string"))),
    ))
    return rows.withColumns({
        "abbr": abbr, "day": F.when(abbr.isNotNull(), day), "year_raw": F.when(abbr.isNotNull() & (got(3) != ""), got(3)),
        "subject": tidy(F.when(abbr.isNotNull(), got(4)).otherwise(F.col(text))), "flags": flags,
    })


def fill_dates(entries: DataFrame, folder: str, order: list[str], date: str = "date") -> DataFrame:
    """A missing date is the latest one above; one earlier than it is flagged.  The latest so far is a running maximum."""
    above = Window.partitionBy(folder).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(date).over(above)
    late = F.when(F.col(date) < latest, F.concat(F.lit("date is out of sequence (after "), F.date_format(latest, "yyyy-MM-dd"), F.lit(")")))
    return entries.withColumns({"final_date": F.coalesce(F.col(date), latest), "flag": F.coalesce(late, F.lit(""))})


def usual(values: DataFrame, folder: str, value: str, order: str) -> DataFrame:
    """The most common value of each folder; of equally common ones the one seen first."""
    counts = values.where(F.col(value).isNotNull()).groupBy(folder, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(folder).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def in_order(rows: DataFrame, folder: str, order: str, day: str) -> DataFrame:
    """rows of a page with days -> folder, rows, dated, rising, is_list: enough dated rows that mostly don't go back."""
    w = Window.partitionBy(folder).orderBy(order)
    dated = rows.where(F.col(day).isNotNull()).withColumn("up", F.col(day) >= F.lag(day).over(w))
    counts = dated.groupBy(folder).agg(F.count("*").alias("dated"), F.count_if("up").alias("rising"))
    every = rows.groupBy(folder).agg(F.count("*").alias("rows"))
    out = every.join(counts, folder, "left").select(folder, "rows", F.coalesce("dated", F.lit(0)).alias("dated"), F.coalesce("rising", F.lit(0)).alias("rising"))
    enough = (F.col("dated") >= LIST_ROWS) & (F.col("dated") >= LIST_SHARE * F.col("rows")) & (F.col("rising") >= ORDER_SHARE * (F.col("dated") - 1))
    return out.withColumn("is_list", enough)

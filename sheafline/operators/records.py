"""Result tables: upsert by page, names and numbers, projection by template, scoring against an answer key."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alnum

# The result row, in order, and the columns an older version had.
RESULT_COLUMNS = (
    "file page item_number release_date release_date_as_printed first_five_words date_verified words_verified date_confidence words_confidence language needs_review review_reasons "
    "subject subject_verified subject_match slug opening_text page_count pages folder box folder_no release_no file_name digitized"
).split()
OLDEST_COLUMNS = 13
# The buckets of a scored field.
BUCKETS = ("no_answer", "verified_right", "verified_wrong", "flagged_right", "flagged_wrong")


def upsert(old: DataFrame, new: DataFrame, consumed: DataFrame, folder: str) -> DataFrame:
    """old and new hold (file, page, folder, ord); old rows of this folder, or of none, whose page was read again go, and
    the new rows come last.  A replay gives the same table."""
    gone = old.where(F.col("folder").isin(folder, "")).join(consumed, ["file", "page"], "left_semi").select("file", "page", "folder").distinct()
    kept = old.join(gone, ["file", "page", "folder"], "left_anti")
    top = kept.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top")).scalar()
    return kept.unionByName(new.withColumn("ord", F.col("ord") + top + 1))


def adopt_columns(rows: DataFrame) -> DataFrame:
    """An older table, whose columns are the first ones of today's, with the newer ones blank."""
    have = rows.columns
    if have != RESULT_COLUMNS[: len(have)] or len(have) < OLDEST_COLUMNS:
        raise ValueError("the table's columns are not those of this or an older version")
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in RESULT_COLUMNS])


def number_releases(releases: DataFrame, folder: str, order: str, first: int = 1) -> DataFrame:
    """release_no counts a folder's releases in scan order; a release of many pages counts once."""
    return releases.withColumn("release_no", F.row_number().over(Window.partitionBy(folder).orderBy(order)) + F.lit(first - 1))


def box_and_folder(path: Column) -> tuple[Column, Column]:
    """Labels from the last two parts of a path; an all-digit leaf counts as a folder inside a box."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    leaf, above = F.coalesce(F.element_at(parts, -1), F.lit("")), F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))
    box_in = lambda part: F.regexp_extract(part, r"(?i)\bbox[ _-]*([A-Za-z0-9]{1,8})\b", 1)
    folder_in = lambda part: F.regexp_extract(part, r"(?i)\bfolder[ _-]*([A-Za-z0-9]{1,8})\b", 1)
    box = F.when(box_in(leaf) != "", box_in(leaf)).otherwise(box_in(above))
    folder = F.when(folder_in(leaf) != "", folder_in(leaf)).when((box_in(above) != "") & leaf.rlike("^[0-9]{1,8}$"), leaf).otherwise(F.lit(""))
    return box, folder


LABEL = re.compile(r"[A-Za-z0-9]{1,8}")
DEVICES = frozenset("con prn aux nul".split()) | {f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10)}
PLACEHOLDERS = ("box", "folder", "release")


def name_template(template: str, box: str, folder: str) -> Column:
    """A file name per release from a template with {box}, {folder} and {release}; refuses what no file system takes."""
    if not LABEL.fullmatch(box) or not LABEL.fullmatch(folder):
        raise ValueError("labels are 1 to 8 letters or digits")
    wanted = re.findall(r"\{([^}]*)\}", template)
    if set(wanted) - set(PLACEHOLDERS) or "release" not in wanted:
        raise ValueError("the template names {box}, {folder} and {release}, the last at least")
    if re.search(r'[<>:"/\\|?*\x00-\x1f]', template) or template.endswith((".", " ")) or template.split(".")[0].lower() in DEVICES:
        raise ValueError("not a safe file name")
    pieces = re.split(r"(\{[^}]*\})", template)
    value = {"{box}": F.lit(box), "{folder}": F.lit(folder), "{release}": F.col("release_no").cast("string")}
    return F.concat(*[value.get(p, F.lit(p)) for p in pieces if p])


def project(rows: DataFrame, template: list[tuple[str, str]]) -> DataFrame:
    """Columns c0.. by a template of (heading, value), where a value names result columns in braces.  Headings may
    repeat; rows without a file name are left out; `title` is the subject, or else the first words."""
    title = F.when(F.coalesce("subject", F.lit("")) != "", F.col("subject")).otherwise(F.col("first_five_words"))
    known = rows.withColumn("title", title)
    out = []
    for i, (_, value) in enumerate(template):
        pieces = [p for p in re.split(r"(\{[^}]*\})", value) if p]
        names = [p[1:-1] for p in pieces if p.startswith("{")]
        if unknown := set(names) - set(known.columns):
            raise ValueError(f"the template names unknown columns: {sorted(unknown)}")
        made = [F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("")) if p.startswith("{") else F.lit(p) for p in pieces] or [F.lit("")]
        out.append(F.concat(*made).alias(f"c{i}"))
    return known.where(F.coalesce("file_name", F.lit("")) != "").select(*out)


def bucket(value: Column, verified: Column, truth: Column) -> Column:
    """One of the five buckets; null where the key is blank."""
    right = F.regexp_replace(F.trim(value), r"\s+", " ") == F.regexp_replace(F.trim(truth), r"\s+", " ")
    word = F.when(verified, "verified_").otherwise("flagged_")
    return F.when(truth == "", F.lit(None)).when(value == "", "no_answer").otherwise(F.concat(word, F.when(right, "right").otherwise("wrong")))


def last_of_file(results: DataFrame, order: str) -> DataFrame:
    """The last row of each file."""
    return results.groupBy("file").agg(F.max_by(F.struct(*[c for c in results.columns if c != "file"]), order).alias("r")).select("file", "r.*")


def diff_kind(ours: Column, truth: Column) -> Column:
    """How two texts differ: CASE, PUNCT, both, or LETTERS; empty if they don't."""
    case = (F.lower(ours) == F.lower(truth))
    letters = alnum(ours) == alnum(truth)
    both = F.lower(alnum(ours)) == F.lower(alnum(truth))
    return F.when(ours == truth, "").when(case, "CASE").when(letters, "PUNCT").when(both, "CASE+PUNCT").otherwise("LETTERS")


def next_number(names: DataFrame, name: str = "name") -> DataFrame:
    """One more than the largest number a name begins with."""
    return names.agg((F.coalesce(F.max(F.regexp_extract(name, "^0*([0-9]{1,9})", 1).try_cast("int")), F.lit(0)) + 1).cast("long").alias("next_number"))

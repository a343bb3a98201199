"""Names of result files: what is a usable naming, which names it makes, and what is to be written."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import name_template

# What becomes of a file of the plan.
WRITE, LEAVE, STALE = "write", "leave", "stale"


def typed_first(*choices: Column) -> Column:
    """The first choice that is neither null nor empty: typed, then the template's, then the default."""
    return F.coalesce(*[F.when(c != "", c) for c in choices])


def filled(template: str, box: str, folder: str, number: str = "") -> str:
    for name, value in (("box", box), ("folder", folder), ("release", number)):
        template = template.replace("{" + name + "}", value)
    return template


def check_naming(box: str, folder: str, first: int, template: str, list_template: str) -> None:
    """Refuses a naming under which two files would share a name, or that no file system takes."""
    name_template(template, box, folder)
    name_template(list_template + "{release}", box, folder)
    if first < 1:
        raise ValueError("the first release number is 1 or more")
    listed = filled(list_template, box, folder, "0")
    if not listed.strip() or owned_pattern(template, box, folder).fullmatch(listed):
        raise ValueError("the list page needs a name that no release has")


def owned_pattern(template: str, box: str, folder: str) -> re.Pattern:
    parts = [re.escape(filled(p, box, folder)) for p in template.split("{release}")]
    return re.compile("(?i)" + r"\d+".join(parts))


def owns(name: Column, template: str, list_template: str, box: str, folder: str) -> Column:
    """Is this a name that the naming makes, for any number?"""
    pattern = r"\d+".join(re.escape(filled(p, box, folder)) for p in template.split("{release}"))
    return name.rlike(f"^(?:{pattern})$") | (name == filled(list_template, box, folder, "0"))


def write_plan(pages: DataFrame, existing: DataFrame, ours: Column, force: bool = False) -> DataFrame:
    """pages(file_name, file, page, ord), existing(file_name) -> file_name, n_pages, pages (file and page in order) and
    action: names to write, names there already, left alone unless forced, and names of an earlier run (`ours`, over
    file_name) that nothing makes now.  Other files of the folder are not told."""
    named = pages.where(F.coalesce("file_name", F.lit("")) != "")
    made = named.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("ord", "file", "page"))).alias("p"))
    made = made.select("file_name", F.transform("p", lambda x: F.concat_ws("#", x["file"], x["page"])).alias("pages"), F.lit(True).alias("made"))
    both = made.join(existing.select("file_name").distinct().withColumn("there", F.lit(True)), "file_name", "full")
    action = F.when(F.col("made") & (F.col("there").isNull() | F.lit(force)), WRITE).when(F.col("made"), LEAVE).when(ours, STALE)
    out = both.select("file_name", F.coalesce(F.size("pages"), F.lit(0)).cast("long").alias("n_pages"), F.coalesce(F.array_join("pages", " "), F.lit("")).alias("pages"), action.alias("action"))
    return out.where("action is not null")

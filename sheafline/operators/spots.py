"""Places on a page as expressions: words at characters of a line, boxes that meet, the line nearest a crop's middle, and
characters of a recogniser's time steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The share of the lower box that two readings of one spot have in common, and the blank of a recogniser.
COMMON_HEIGHT, BLANK = 0.5, 0


def _begun(words: Column, at: Column) -> Column:
    """How many words begin before character `at` of the line that one space parts: one more than the spaces before the
    character ahead of it."""
    before = F.left(F.array_join(words, " "), F.greatest(at - 1, F.lit(0)))
    spaces = F.length(before) - F.length(F.replace(before, F.lit(" ")))
    return F.when(at <= 0, 0).otherwise(F.least(spaces + 1, F.size(words)))


def words_in_span(words: Column, start: Column, end: Column) -> Column:
    """The words that overlap characters start..end - 1 of the line; none for an empty span or line."""
    text = F.array_join(words, " ")
    over = F.left(text, F.greatest(start + 1, F.lit(0)))
    done = F.length(over) - F.length(F.replace(over, F.lit(" ")))  # a word is over where its space comes
    done = F.when(start >= F.length(text), F.size(words)).otherwise(done)
    return F.slice(words, done + 1, F.greatest(_begun(words, end) - done, F.lit(0)))


def word_index_at(words: Column, at: Column) -> Column:
    """The first word, from 0, that begins at character `at` or later; the number of words if none does."""
    return _begun(words, at)


def same_spot(a: Column, b: Column) -> Column:
    """Do two boxes (structs of x0, y0, x1, y1) meet across, and over more than half the lower one's height?"""
    across = F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])
    down = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return across & (down > F.least(a["y1"] - a["y0"], b["y1"] - b["y0"]) * COMMON_HEIGHT)


def padded(box: Column, pad: Column, width: Column, height: Column) -> Column:
    """The box wider by `pad` on every side, inside the page."""
    sides = {"x0": F.greatest(box["x0"] - pad, F.lit(0)), "y0": F.greatest(box["y0"] - pad, F.lit(0)), "x1": F.least(box["x1"] + pad, width), "y1": F.least(box["y1"] + pad, height)}
    return F.struct(*[c.alias(n) for n, c in sides.items()])


def nearest_line(lines: Column, height: Column) -> Column:
    """Of lines (structs with y0 and y1) the one whose middle is nearest that of a crop of this height, the first of
    several; null if there is none."""
    off = F.transform(lines, lambda line, i: F.struct(F.abs((line["y0"] + line["y1"]) / 2 - height / 2).alias("off"), i.alias("i")))
    return F.get(lines, F.array_min(off)["i"])


def steps_to_words(steps: Column) -> Column:
    """steps: array<struct<code:int,prob:double>>, a recogniser's best class per time step, code points with 0 for none.

    A character is the first step of a run; words are what spaces part, array<struct<text:string,conf:double>> with 100
    times the least probability of a word's characters.
    """
    fresh = F.filter(steps, lambda s, i: (s["code"] != BLANK) & ((i == 0) | (s["code"] != F.get(steps, i - 1)["code"])))
    text = F.array_join(F.transform(fresh, lambda s: F.char(s["code"])), "")
    ends = F.concat(F.filter(F.transform(fresh, lambda s, i: F.when(s["code"] == 32, i)), lambda i: i.isNotNull()), F.array(F.size(fresh)))
    spans = F.transform(ends, lambda e, k: F.struct(F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1).alias("a"), e.alias("b")))
    word = lambda s: F.struct(F.substr(text, s["a"] + 1, s["b"] - s["a"]).alias("text"), (F.array_min(F.slice(fresh, s["a"] + 1, s["b"] - s["a"])["prob"]) * 100).alias("conf"))
    return F.transform(F.filter(spans, lambda s: s["b"] > s["a"]), word)

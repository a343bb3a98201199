"""Scalar text functions as Column expressions.

Python's \\w is letters, numbers and underscore: [\\p{L}\\p{N}_] in Java's and DuckDB's patterns alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"\p{L}\p{N}_"
# Letters and numbers of Unicode 14 and 15, which DuckDB's classes hold and those of Java 17 do not.
NEWER_LETTERS = (
    "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 "
    "10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 "
    "11f12-11f33 12f90-12ff0 1342f 13441-13446 16a70-16abe 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad "
    "1e4d0-1e4eb 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af"
)
NEWER_NUMBERS = "11f50-11f59 16ac0-16ac9 1d2c0-1d2d3 1e4f0-1e4f9"


def _newer(hexes: str) -> str:
    """A class within one range, so that common marks fail at once."""
    return r"[\x{870}-\x{323af}&&[" + "".join("-".join(rf"\x{{{end}}}" for end in run.split("-")) for run in hexes.split()) + "]]"


#: Letters and numbers of a word by itself; over whole texts the shorter W is used.
LETTER = r"\p{L}" + _newer(NEWER_LETTERS)
LETTER_OR_NUMBER = LETTER + r"\p{N}" + _newer(NEWER_NUMBERS)
#: DuckDB's \s; Java's takes the vertical tab too.
SQL_SPACE = r"[ \t\n\f\r]"

# Leading articles by language.
ARTICLES = {
    "en": ["the", "a", "an"],
    "fr": ["le", "la", "les", "un", "une", "des", "du"],
    "es": ["el", "la", "los", "las", "lo", "un", "una", "unos", "unas"],
    "it": ["il", "lo", "la", "i", "gli", "le", "un", "uno", "una"],
    "pt": ["o", "a", "os", "as", "um", "uma", "uns", "umas"],
    "de": ["der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "eines"],
    "nl": ["de", "het", "een", "'t", "'n"],
    "ca": ["el", "la", "els", "les", "un", "una", "uns", "unes"],
    "sv": ["en", "ett", "den", "det", "de"],
    "da": ["en", "et", "den", "det", "de"],
    "no": ["en", "ei", "et", "den", "det", "de"],
    "ro": ["un", "o", "niște"],
    "hu": ["a", "az", "egy"],
    "el": ["ο", "η", "το", "οι", "τα", "του", "της", "των", "τον", "την", "ένας", "μία", "μια", "ένα"],
    "eo": ["la"],
    "ga": ["an", "na"],
    "cy": ["y", "yr"],
}
# Articles that elide onto the next word.
ELIDED = {"fr": ["l"], "it": ["l", "un", "gl"], "ca": ["l"]}
# Common function words by language, in the order that settles ties.
STOPWORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "for", "that", "with", "on", "will", "was", "at", "by", "has"],
    "fr": ["le", "la", "les", "et", "des", "du", "est", "pour", "dans", "que", "une", "sur", "avec", "au", "qui"],
    "es": ["el", "los", "las", "y", "del", "que", "en", "por", "con", "para", "una", "es", "se", "al"],
    "it": ["il", "gli", "e", "di", "che", "della", "per", "con", "una", "è", "del", "nel", "sono", "alla"],
    "pt": ["o", "os", "e", "do", "da", "que", "em", "para", "com", "uma", "não", "dos", "das", "ao"],
    "de": ["der", "die", "das", "und", "ist", "von", "mit", "für", "den", "ein", "eine", "nicht", "auf", "wird"],
    "nl": ["de", "het", "een", "en", "van", "is", "dat", "op", "voor", "met", "niet", "zijn", "worden"],
    "ca": ["els", "les", "i", "del", "que", "amb", "per", "una", "és", "dels", "als"],
    "sv": ["och", "att", "det", "som", "är", "för", "med", "på", "av", "till", "ett", "inte"],
    "da": ["og", "at", "det", "som", "er", "for", "med", "på", "af", "til", "et", "ikke"],
    "no": ["og", "at", "det", "som", "er", "for", "med", "på", "av", "til", "et", "ikke", "ei"],
    "ro": ["și", "în", "de", "la", "cu", "pe", "care", "este", "din", "pentru", "un", "o"],
    "hu": ["a", "az", "és", "hogy", "nem", "egy", "is", "van", "meg", "volt"],
    "el": ["και", "το", "η", "ο", "της", "του", "να", "με", "για", "την", "σε"],
}
# Abbreviations that keep their full stop, and the marks stripped from a word's edges.
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "inc", "co", "corp", "ltd", "no", "dept", "univ", "gen", "sen", "rep", "gov", "rev", "capt", "lt", "col", "mt"]
EDGE_LEAD = "\"“”„«»‹›‘’'`([{<¿¡*•·-–—"
EDGE_TRAIL = "\"“”„«»‹›‘’'`)]}>,;:!?*•·"
APOSTROPHES = "'’ʼ`´"
# The least detection evidence.
LEAST_TOKENS, LEAST_HITS = 20, 5


def _single_capitals() -> tuple[str, str]:
    """Lower-case letters whose capitals are several characters, or newer than Unicode 15, and what stands for each: its
    one capital, its one title-case letter or itself."""
    several = [c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1]
    newer = [*"ƛɤ\u1c8a\ua7cd\ua7db", *map(chr, range(0x10D70, 0x10D86))]
    one = {c: c.title() if len(c.title()) == 1 else c for c in several} | {c: c for c in newer} | {"ß": "ẞ"}
    return "".join(one), "".join(one.values())


# Capitals that full case mapping would spell with several characters.
ODD_LETTERS, ODD_CAPITALS = _single_capitals()


def in_class(chars: str) -> str:
    """A pattern's character class of exactly these characters."""
    return "[" + "".join("\\" + c if c in "\\]^-[&" else c for c in chars) + "]"


def words(text: Column, space: str = r"\s") -> Column:
    """Runs of non-space characters."""
    return F.array_remove(F.split(text, f"{space}+"), "")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of word characters and apostrophes."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"([{W}']+)"), F.lit(1)), F.lower)


def lower_letters(text: Column) -> Column:
    """Lower case character by character, whatever stands around one: no final sigma, a plain i for a dotted one."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def upper_letter(letter: Column) -> Column:
    """One character's capital as one character: ẞ for ß, not SS."""
    return F.when(F.instr(F.lit(ODD_LETTERS), letter) > 0, F.translate(letter, ODD_LETTERS, ODD_CAPITALS)).otherwise(F.upper(letter))


def is_word(token: Column) -> Column:
    # the plain class settles nearly all words of a text
    return token.rlike(r"[\p{L}\p{N}]") | token.rlike(f"[{LETTER_OR_NUMBER}]")


def alnum(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{LETTER_OR_NUMBER}]", "")


def clean_word(token: Column) -> Column:
    """Edge punctuation off; the full stop of an abbreviation, an initial or a dotted word stays.

    Input is taken to be in NFC; Spark has no function for it.
    """
    # \z: Java's $ also stands before a last line separator, such as U+2028
    bare = F.regexp_replace(F.regexp_replace(token, f"^{in_class(EDGE_LEAD)}+", ""), rf"{in_class(EDGE_TRAIL)}+\z", "")
    core = F.regexp_replace(bare, r"\.+\z", "")
    keeps = core.contains(".") | lower_letters(core).isin(ABBREVIATIONS) | core.rlike(rf"^[{LETTER}]\z")
    return F.when(F.lower(token).isin("'t", "'n"), token).when(bare.endswith(".") & ~keeps, core).otherwise(bare)


def capitalize_first(word: Column) -> Column:
    """The first letter in upper case, whatever stands before it."""
    lead = F.regexp_extract(word, f"^([^{LETTER}]*)", 1)
    rest = F.substr(word, F.length(lead) + 1)
    return F.concat(lead, upper_letter(F.substr(rest, F.lit(1), F.lit(1))), F.substr(rest, F.lit(2)))


def word_map(table: dict[str, list[str]], lang: Column) -> Column:
    """The words of the language of a row; those of all languages if it is null; none if it is not known."""
    every = sorted({w for v in table.values() for w in v})
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    return F.when(lang.isNull(), F.array(*map(F.lit, every)) if every else none).otherwise(F.coalesce(known[lang], none))


def strip_elisions(core: Column, elided: Column) -> Column:
    """The word without the elided articles before it: amour of l'amour and of l'l'amour."""
    # each article that goes is one of the leading parts, so there are no more steps than those
    known = F.transform(F.split(core, in_class(APOSTROPHES)), lambda p: F.array_contains(elided, lower_letters(p)))
    first_other = F.array_position(known, False).cast("int")
    leading = F.when(first_other > 0, F.slice(known, 1, first_other - 1)).otherwise(known)

    def step(rest: Column, _: Column) -> Column:
        elision = F.regexp_extract(rest, f"^([{LETTER_OR_NUMBER}_]+){in_class(APOSTROPHES)}[{LETTER_OR_NUMBER}_]", 1)
        return F.when((elision != "") & F.array_contains(elided, lower_letters(elision)), F.substr(rest, F.length(elision) + 2)).otherwise(rest)

    return F.aggregate(leading, core, step)


def strip_articles(tokens: Column, articles: Column, elided: Column) -> Column:
    """struct(removed int, head string): how many words of the array go, and the first one left (null if none).

    Articles may be stacked or elided; punctuation before a removed article moves to the next word.
    """
    start = F.struct(F.lit(0).alias("removed"), F.lit("").alias("lead"), F.lit(None).cast("string").alias("head"), F.lit(False).alias("cut"))

    def step(acc: Column, token: Column) -> Column:
        word = F.concat(acc["lead"], token)
        lead = F.regexp_extract(word, f"^([^{LETTER_OR_NUMBER}_]*)", 1)
        core = F.substr(word, F.length(lead) + 1)
        after = strip_elisions(core, elided)
        is_elided = after != core
        gone = F.array_contains(articles, lower_letters(word))
        gone_core = F.array_contains(articles, lower_letters(core))
        gone_after = is_elided & F.array_contains(articles, lower_letters(after))
        away = gone | gone_core | gone_after
        return F.when(acc["head"].isNotNull(), acc).otherwise(
            F.struct(
                (acc["removed"] + away.cast("int")).alias("removed"),
                F.when(gone | ~away, F.lit("")).otherwise(lead).alias("lead"),
                F.when(~away, F.when(is_elided, F.concat(lead, after)).otherwise(word)).alias("head"),
                (acc["cut"] | away | is_elided).alias("cut"),
            )
        )

    return F.aggregate(tokens, start, step)


def mask(text: Column) -> Column:
    """Letters become X or x, digits 9: the shape of a text without its content."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}", "X"), r"[\p{L}&&[^X]]", "x"), r"\p{Nd}", "9")


def safe_cell(text: Column) -> Column:
    """A leading = + - @ or ' gets an apostrophe before it, so that no sheet program runs it."""
    return F.when(F.substr(text, F.lit(1), F.lit(1)).isin("=", "+", "-", "@", "'"), F.concat(F.lit("'"), text)).otherwise(text)


def plain_cell(text: Column) -> Column:
    """The exact inverse of safe_cell."""
    escaped = (F.substr(text, F.lit(1), F.lit(1)) == "'") & F.substr(text, F.lit(2), F.lit(1)).isin("=", "+", "-", "@", "'")
    return F.when(escaped, F.substr(text, F.lit(2))).otherwise(text)


def natural_key(path: Column, width: int = 20) -> Column:
    """Sorts as people expect: digit runs by value, text without regard to case."""
    parts = F.regexp_extract_all(F.lower(path), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), width, "0")).otherwise(p))
    return F.array_join(padded, "\x1f")


# Words that say nothing about a subject.
SUBJECT_STOP = ["the", "and", "for", "from", "with", "new", "of"]


def subject_tokens(text: Column, stop: list[str] = SUBJECT_STOP) -> Column:
    """Words of three characters or more without inner apostrophes and hyphens, stop words and the plural s."""
    flat = F.regexp_replace(F.lower(text), rf"(?<=[{W}])['’](?=[{W}])", "")
    flat = F.regexp_replace(flat, rf"(?<=[{W}])-(?=[{W}])", "")
    found = F.regexp_extract_all(flat, F.lit("([a-z0-9]+)"), F.lit(1))
    found = F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(stop))
    return F.transform(found, lambda t: F.when((F.length(t) >= 5) & t.endswith("s") & ~t.endswith("ss"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def release_tokens(text: Column) -> Column:
    """The distinct tokens of a text, hyphenated words both joined and in parts."""
    return F.array_union(subject_tokens(text), subject_tokens(F.regexp_replace(text, "-", " ")))


def compounds(subject: Column) -> Column:
    """Map of each hyphenated word, joined as its token is, to the tokens of its parts, where there are several."""
    found = F.regexp_extract_all(F.lower(subject), F.lit(rf"([{W}]+(?:-[{W}]+)+)"), F.lit(1))
    pairs = F.transform(found, lambda w: F.struct(F.get(subject_tokens(w), F.lit(0)).alias("key"), subject_tokens(F.regexp_replace(w, "-", " ")).alias("value")))
    whole = F.filter(pairs, lambda p: p["key"].isNotNull() & (F.size(p["value"]) > 1))
    keys = F.array_distinct(F.transform(whole, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(whole, lambda p: p["key"] == k), F.lit(0))["value"]))


def word_key(word: Column) -> Column:
    """A word's letters and digits in lower case."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]", "")


def word_parts(word: Column) -> Column:
    """Keys of the parts that dashes and slashes separate."""
    return F.array_remove(F.transform(F.split(word, "[-–—/]+"), word_key), "")


def zipf(count: Column, total: Column) -> Column:
    """log10 of the occurrences in a thousand million words."""
    return F.log10(count * 1e9 / total)


# What a typewriter types.
TYPED = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,;:'\"!?()&-/$%#*+=@“”‘’—–"


def strays(text: Column) -> Column:
    """Characters outside the typewriter's set, distinct and in order, joined by spaces."""
    left = F.regexp_replace(text, f"{in_class(TYPED)}+", "")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(left, ""), lambda c: c != ""))), " ")


def hamming(a: Column, b: Column) -> Column:
    """Places where two strings of one length differ."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def is_unfinished(text: Column) -> Column:
    """Stops mid-way: on a single hyphen, with a bracket open or with an odd number of double quotes."""
    bare = F.rtrim(text)
    count = lambda c: F.length(bare) - F.length(F.regexp_replace(bare, c, ""))
    return (bare.endswith("-") & ~bare.endswith("--")) | (count("[(]") > count("[)]")) | (count('["“”]') % 2 == 1)


def letters_only(text: Column) -> Column:
    """Lower case, with letters a to z and spaces only."""
    return F.regexp_replace(F.lower(text), "[^a-z ]", "")


def single_spaced(text: Column) -> Column:
    """Words with one space between them."""
    return F.array_join(words(text), " ")

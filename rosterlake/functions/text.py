"""Column expressions over text: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no signal in a search.
STOPWORDS = tuple(
    "a an and are as at be been by for from has have in is it its of on or that the to was were will with".split()
)
#: Fixed value: a search term keeps the punctuation of technical names (c++, node.js, gpt-4).
TERM = r"[a-z0-9][a-z0-9+.#_-]*"
#: White space, the Unicode kinds included.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The longest stored name, headline, rationale and indexed text.
CAPS = {"name": 200, "headline": 400, "rationale": 1000, "document": 20_000}


def terms(text: Column, strip_end: bool = False) -> Column:
    """Search terms: lower case, no stopwords, more than one character; an empty array for null.

    ``strip_end`` drops full stops and dashes from the end of a term, which the
    plain rule keeps.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), 1)
    if strip_end:
        found = F.transform(found, lambda t: F.regexp_replace(t, r"[.\-_]+$", ""))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for null and blank."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != ""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def capped(text: Column, what: str) -> Column:
    """The first characters of a text, by code point, as many as ``what`` may have."""
    return F.substring(text, 1, CAPS[what])


def holds(needle: str, *columns: Column) -> Column:
    """Whether any of the columns contains the text, upper or lower case; null columns count as empty."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.coalesce(c, F.lit(""))).contains(needle.lower())
    return found


def initials(name: Column) -> Column:
    """First letters of the first two words, in upper case."""
    words = F.filter(F.split(strip(F.coalesce(name, F.lit(""))), SPACE + "+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def time_ago(then: Column, now: Column) -> Column:
    """How long ago a moment in epoch seconds was: never, just now, or minutes, hours or days."""
    gone = now - then
    return (
        F.when(then.isNull() | (then == 0), "never")
        .when(gone < 60, "just now")
        .when(gone < 3600, F.concat(F.floor(gone / 60).cast("string"), F.lit("m ago")))
        .when(gone < 86400, F.concat(F.floor(gone / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(gone / 86400).cast("string"), F.lit("d ago")))
    )


def percent(score: Column) -> Column:
    """A score of 0 to 1 in per cent, rounded half up; 0 for null."""
    return F.coalesce(F.floor(score * 100 + 0.5), F.lit(0)).cast("bigint")


def percent_label(score: Column) -> Column:
    return F.when(score.isNull(), "--").otherwise(percent(score).cast("string"))

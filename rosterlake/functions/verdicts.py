"""Scores and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlake.functions.text import strip

#: The ladder of verdicts, the label of each, and the one that stands for anything else.
LADDER = ("INTERVIEW", "MAYBE", "PASS")
LABELS = {"INTERVIEW": "Interview", "MAYBE": "Maybe", "PASS": "Pass"}
DEFAULT, UNSCORED = "MAYBE", "Unscored"
#: Words of a rich record, and the shares from which a verdict is given.
RICH, INTERVIEW_FROM, MAYBE_FROM = 220, 0.66, 0.33


def normalised(raw: Column) -> Column:
    """A verdict of the ladder, whatever its case or spacing; ``MAYBE`` for all else and for null."""
    tidy = F.replace(F.upper(strip(F.coalesce(raw, F.lit("")))), F.lit(" "), F.lit("_"))
    return F.when(tidy.isin(*LADDER), tidy).otherwise(DEFAULT)


def clamped(raw: Column) -> Column:
    """A number between 0 and 1; text is read as a number, anything else is 0."""
    number = raw.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))


def label(verdict: Column) -> Column:
    out = F.lit(UNSCORED)
    for code, text in LABELS.items():
        out = F.when(verdict == code, text).otherwise(out)
    return out


def richness(words: Column) -> Column:
    """How much a record says, from 0 to 1."""
    return F.least(F.lit(1.0), words / F.lit(float(RICH)))


def by_richness(share: Column) -> Column:
    return F.when(share > INTERVIEW_FROM, "INTERVIEW").when(share > MAYBE_FROM, "MAYBE").otherwise("PASS")

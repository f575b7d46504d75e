"""Redaction of credentials: chained Catalyst expressions, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "<CREDENTIAL_REDACTED>"

#: What credentials look like, in the order in which they are replaced. The replacement of the last one
#: keeps the name that the value was given.
PATTERNS = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", TOKEN),
    (r"(?U)(?<![\w.])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}(?![\w.])", TOKEN),
    (r"(?U)(?<![\w-])AIza[0-9A-Za-z_\-]{35}(?![\w-])", TOKEN),
    (r"(?U)(?<![\w-])(?:AKIA|ASIA)[0-9A-Z]{16}(?![\w-])", TOKEN),
    (r"(?U)(?<![\w-])(?:sk|pk|rk|lf|lk|ghp|gho|xoxb|xoxp)[_-][0-9A-Za-z_\-]{16,}(?![\w-])", TOKEN),
    (r"(?iU)\b(?:bearer|basic|token)\s+[0-9A-Za-z._\-+/=]{12,}", TOKEN),
    (
        r"(?iU)\b([\w.\-]*(?:api[_-]?key|secret|password|passwd|token|credential)[\w.\-]*)[\"']?\s*[:=]\s*[\"']?([^\s\"',;}]{8,})[\"']?",
        r"$1=" + TOKEN,
    ),
)


def redacted(text: Column) -> Column:
    """The text with every credential replaced; null stays null."""
    for pattern, token in PATTERNS:
        text = F.regexp_replace(text, pattern, token)
    return text


def counted(text: Column) -> Column:
    """How many credentials a text holds; each pattern counts in what the ones before it left."""
    text, total = F.coalesce(text, F.lit("")), F.lit(0)
    for pattern, token in PATTERNS:
        total = total + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, token)
    return total


def gate(text: Column) -> Column:
    """The text, or an error if it holds a credential: for use right before data leaves."""
    n = counted(text)
    message = F.concat(n.cast("string"), F.lit(" credential-shaped value(s) at the boundary"))
    return F.when(n == 0, text).otherwise(F.raise_error(message).cast("string"))

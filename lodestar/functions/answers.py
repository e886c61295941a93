"""Answers and the texts around them: normal forms, comparison, shortening, escaping and masking."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "cast(array() as array<string>)"
# What masks a secret, and the shapes of secrets, addresses and paths in messages.
MASK = "[redacted]"
SECRETS = [
    (r"(?i)\b(authorization\s*:\s*)?bearer\s+[A-Za-z0-9._~+/=-]+", f"Bearer {MASK}"),
    (r"(?i)\b(password|passwd|secret|token|api[_-]?key)(\s*[=:]\s*)[^\s,;&]+", f"$1$2{MASK}"),
    (r"(?i)\bhttps?://[^\s]+", "[url]"),
]
PATHS = (r"(?<![\w/])/(?:[\w.-]+/)+[\w.-]*", "[path]")


def normal_token(value: str) -> str:
    """Compatibility forms, no combining marks, long dashes as hyphens, single spaces, case-folded."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", value))
    text = "".join("-" if c in "–—" else c for c in text if not unicodedata.combining(c))
    return " ".join(text.split()).casefold()


def normal_tokens(answer: Column) -> Column:
    """normal_token of each item; NULL is no item."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda items: [normal_token(i or "") for i in items] if items is not None else [])

    return F.pandas_udf(run, "array<string>")(answer)


def number(text: Column) -> Column:
    """The number that the whole text is, a whole one or with decimals; NULL otherwise. Exact to 18 decimals."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"^-?[0-9]+(?:\.[0-9]+)?\z"), plain.try_cast("decimal(38,18)"))


def match_exact(predicted: Column, gold: Column) -> Column:
    """Arrays are equal as they are; NULL is empty."""
    return F.coalesce(predicted, F.expr(NONE)) == F.coalesce(gold, F.expr(NONE))


def match_normal(predicted: Column, gold: Column) -> Column:
    """Normal forms are equal: as numbers where all items of both are, else as texts. No prediction matches nothing."""
    a, b = normal_tokens(predicted), normal_tokens(gold)
    numeric = lambda own: (F.size(own) > 0) & F.forall(own, lambda v: number(v).isNotNull())
    same = F.when(numeric(a) & numeric(b), F.transform(a, number) == F.transform(b, number)).when(numeric(a) | numeric(b), False).otherwise(a == b)
    return predicted.isNotNull() & F.coalesce(same, F.lit(False))


def shortened(items: Column, limit: int = 80) -> Column:
    """Items joined by ' | ', cut to the limit with an ellipsis."""
    text = F.array_join(F.coalesce(items, F.expr(NONE)), " | ")
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 1)), F.lit("…")))


def bounded(text: Column, most: int) -> Column:
    """Both ends of a text that is too long, with ' ... ' between them, or its start where most is under 32; all of it where most isn't positive."""
    text, head = F.coalesce(text, F.lit("")), (most - 5) // 2
    if most <= 0:
        return text
    ends = F.concat(F.left(text, F.lit(head)), F.lit(" ... "), F.right(text, F.lit(most - 5 - head)))
    return F.when(F.char_length(text) <= most, text).otherwise(ends if most >= 32 else F.left(text, F.lit(most)))


def escaped(text: Column, delimiters: tuple[str, ...] = (">>>UNTRUSTED_EVIDENCE", "<<<UNTRUSTED_EVIDENCE")) -> Column:
    """Backslashes doubled, and what looks like a delimiter broken by one, so that quoted text can't end its quotation."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for sign in delimiters:
        out = F.replace(out, F.lit(sign), F.lit(sign[:2] + "\\" + sign[2:]))
    return out


def masked(text: Column, paths: bool = False) -> Column:
    """A message without secrets and addresses, and, if paths, without file paths."""
    out = text
    for pattern, by in [*SECRETS, *([PATHS] if paths else [])]:
        out = F.regexp_replace(out, pattern, by)
    return out


def run_id(config: Column) -> Column:
    """16 hexadecimal digits that name a struct whose fields stand in order of their names."""
    return F.left(F.sha2(F.to_json(config, {"ignoreNullFields": "false"}), 256), F.lit(16))

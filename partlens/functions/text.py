"""Text and identity expressions: slugs, token patterns, stable uids, dates and money of German pages."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(x: Column) -> Column:
    """Lower case, white space collapsed and trimmed, empty to null (ASCII; see normalize_title for the rest)."""
    y = F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))
    return F.when(y != "", y)


def normalize_title(x: Column) -> Column:
    """``collapse`` after NFKC; Python sees only values that hold more than ASCII."""
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return collapse(F.when(x.rlike(r"[^\x00-\x7F]"), nfkc(x)).otherwise(x))


def slug(x: Column) -> Column:
    y = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(y.isNull() | (y == ""), F.lit("unknown")).otherwise(y)


def slug_id(*parts: Column) -> Column:
    return F.concat_ws("_", *[slug(p) for p in parts])


def alnum_count(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def escape(token: Column) -> Column:
    return F.regexp_replace(token, r"([^A-Za-z0-9_])", r"\\$1")


def spaced(title: Column) -> Column:
    """The title in lower case with a space for each character that is in no word, and around it; null where it holds more than ASCII."""
    return F.when(F.length(title) == F.octet_length(title), F.concat(F.lit(" "), F.regexp_replace(F.lower(title), "[^a-z0-9_ ]", " "), F.lit(" ")))


def has_token(title: Column, token: Column, words: Column | None = None) -> Column:
    """The token stands in the title between word boundaries, case aside; words: ``spaced`` of the title, in which a plain word needs no pattern."""
    # a pattern is made for each row, so only where the token is found as it stands; a sigma's lower case depends on its neighbours
    near = F.contains(F.lower(title), F.lower(token)) | F.contains(title, F.lit("Σ"))
    found = near & F.rlike(title, F.concat(F.lit(r"(?i)\b"), escape(token), F.lit(r"\b")))
    if words is None:
        return found
    return F.when(words.isNotNull() & token.rlike("^[A-Za-z0-9_]+$"), F.contains(words, F.concat(F.lit(" "), F.lower(token), F.lit(" ")))).otherwise(found)


def stable_uid(prefix: str, *parts: Column) -> Column:
    """prefix + sha256 of the parts joined by a bar; null if a part is missing or blank."""
    blank = F.lit(False)
    for p in parts:
        blank = blank | p.isNull() | (F.trim(p) == "")
    return F.when(~blank, F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", *parts), 256)))


#: fixed values: German month names as pages abbreviate them
MONTHS = {"Jan": "01", "Feb": "02", "Mrz": "03", "Mär": "03", "Apr": "04", "Mai": "05", "Jun": "06", "Jul": "07", "Aug": "08", "Sep": "09", "Okt": "10", "Nov": "11", "Dez": "12"}


def german_date(x: Column) -> Column:
    """'7. Aug 2025' as a date; what doesn't parse is null."""
    parts = [F.regexp_extract(x, r"^\s*(\d{1,2})\.\s*([A-Za-zä]{3})[a-z]*\.?\s+(\d{4})\s*$", i) for i in (1, 2, 3)]
    month = F.create_map(*[F.lit(v) for kv in MONTHS.items() for v in kv])[parts[1]]
    return F.try_to_date(F.concat_ws("-", parts[2], month, F.lpad(parts[0], 2, "0")), "yyyy-MM-dd")


def german_money(x: Column) -> Column:
    """'EUR 1.234,56' as a number."""
    digits = F.regexp_extract(x, r"(\d[\d.]*(?:,\d+)?)", 1)
    return F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")

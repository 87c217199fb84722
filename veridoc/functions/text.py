"""Column expressions over texts: tokens, stems, sentences, names, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that are left out unless others are given.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with")
# A run of 255 characters is a token and swallows the character after it.
TOKEN = "([A-Za-z0-9]{1,255})[A-Za-z0-9]?"


def readable(text: Column) -> Column:
    """What comes before the first NUL."""
    return F.substring_index(text, "\0", 1)


def stem(token: Column) -> Column:
    """At most one ending goes, from lower-case tokens long enough."""
    size = F.length(token)
    cut = lambda n: F.substring(token, F.lit(1), size - n)
    return F.when((size > 5) & token.endswith("ing"), cut(3)).when((size > 4) & (token.endswith("ed") | token.endswith("es")), cut(2)).when((size > 3) & token.endswith("s"), cut(1)).otherwise(token)


def tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Stems of all runs of ASCII letters and digits, without those that are stopwords once stemmed."""
    # Lowering can make ASCII letters of others, so it comes after the cut.
    found = F.transform(F.regexp_extract_all(F.coalesce(readable(text), F.lit("")), F.lit(TOKEN), F.lit(1)), lambda t: stem(F.lower(t)))
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def sentences(text: Column) -> Column:
    """Pieces between full stops, exclamation and question marks."""
    return F.split(F.coalesce(readable(text), F.lit("")), "[.!?]")


def windows(items: Column, width: int) -> Column:
    """All runs of so many neighbours; none if there are fewer."""
    last = F.size(items) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i + 1, width))).otherwise(F.array().cast("array<array<string>>"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def severity(score: Column) -> Column:
    return F.when(score > 0.9, "High").when(score > 0.8, "Medium").otherwise("Low")


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def csv_text(text: Column) -> Column:
    """As csv_field, of a column."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\\n\\r]'), quoted).otherwise(text)


def json_text(text: Column) -> Column:
    """A text as a JSON string; only what must be is escaped."""
    inside = F.to_json(F.struct(text.alias("x")))
    return F.substring(inside, F.lit(6), F.length(inside) - 6)


def csv_field(value: str) -> str:
    """Quoted only if it holds a quote, comma or line break."""
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in '",\n\r') else value

"""Text expressions: normalising, identity, model inputs, tokens, n-grams.

All are native column expressions, so they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlens.functions.schema_text import schema_prose

# The code points Unicode-aware stripping removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: a word is a run of two or more letters, digits or underscores.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _rest(items: Column) -> Column:
    """Everything after the first element."""
    return F.slice(items, F.lit(2), F.size(items))


def field(c: Column) -> Column:
    """NULL as the empty string, anything else as text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` alone removes spaces only)."""
    return F.trim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return strip(field(c)) == ""


def content_hash(name: Column, description: Column, schema: Column) -> Column:
    """SHA-256 of the three fields, NULL as empty, not stripped."""
    return F.sha2(F.concat_ws("\n", field(name), field(description), field(schema)), 256)


def model_text(name: Column, description: Column, schema: Column) -> Column:
    """Prose input of the language model; a NULL field prints as ``None``."""

    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("None"))

    return F.concat(
        F.lit("Tool name: "),
        shown(name),
        F.lit("\nDescription: "),
        shown(description),
        F.lit("\n"),
        schema_prose(schema),
    )


def baseline_text(name: Column, description: Column, schema: Column) -> Column:
    """Labelled lines for the linear model: raw schema, NULL as empty."""
    return F.concat(
        F.lit("Tool name: "),
        strip(field(name)),
        F.lit("\nDescription: "),
        strip(field(description)),
        F.lit("\nInput schema: "),
        strip(field(schema)),
    )


def similarity_text(name: Column, description: Column, schema: Column) -> Column:
    """The three stripped fields without labels, one per line."""
    return F.concat_ws("\n", *[strip(field(c)) for c in (name, description, schema)])


def words(c: Column) -> Column:
    """Lower-cased word tokens in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by adjacent pairs. ``tokens`` should be a plain column."""
    pairs = F.zip_with(
        tokens,
        _rest(tokens),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    # zip_with pads the shorter side, so the last word pairs with NULL.
    return F.concat(tokens, F.array_compact(pairs))


def truncate_tokens(tokens: Column, limit: int) -> Column:
    """Keep the first ``limit`` tokens."""
    return F.slice(tokens, F.lit(1), F.lit(limit))


def mentions(c: Column, word: str) -> Column:
    """Case-insensitive literal substring test, no word boundary."""
    return F.contains(F.lower(field(c)), F.lit(word.lower()))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with four decimals."""
    return F.round(part * F.lit(100.0) / whole, 4)


def percent_finding(share: Column, text: str) -> Column:
    """A sentence that opens with the share at two decimals."""
    return F.format_string("%.2f%% " + text.replace("%", "%%"), share)

"""Text column builders.  All are native Spark expressions (whole-stage codegen or JVM
higher-order functions); no Python runs per row.

Conventions that the DuckDB oracle mirrors exactly:
* whitespace is the ASCII set below, not Java's ``\\s`` (which differs from RE2's);
* punctuation is the ASCII punctuation set (Python's ``string.punctuation``);
* ``substr`` / regex ``.`` work on code points, so astral characters count once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must stay equal to the definitions the metrics follow).
# ASCII whitespace as used by the tokenisers, as a regex character class.
WS_CLASS = "[ \\t\\n\\r\\f\\x0B]"
WS_CHARS = " \t\n\r\f\x0b"
# ASCII punctuation  !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~  as a regex character class.
PUNCT_CLASS = "[!-/:-@\\[-`{-~]"
# Articles dropped by the answer normaliser.
ARTICLES = ["a", "an", "the"]
# Width of the verbatim-overlap character n-grams.
QUIP_WIDTH = 25


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element ``transform``).

    Spark does not share sub-expressions inside lambdas, so an array expression used
    many times in a higher-order function would be recomputed on every call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c) -> Column:
    """Python ``str.strip()`` over ASCII whitespace (``trim`` alone keeps newlines)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def strip_ends(c) -> Column:
    """``strip`` of a column that costs nothing to read again.  ``trim`` looks at every character
    from the right; this does so for texts that end in white space alone."""
    c = _c(c)
    ends = F.lit(False)
    for w in WS_CHARS:
        ends = ends | c.endswith(F.lit(w))
    left = F.ltrim(c, F.lit(WS_CHARS))
    return F.when(ends, F.rtrim(left, F.lit(WS_CHARS))).otherwise(left)


def capitalize(c) -> Column:
    """Python ``str.capitalize``: first code point upper-cased, the rest lower-cased."""
    c = _c(c)
    return F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def whitespace_tokens(c) -> Column:
    """Split on runs of ASCII whitespace, empty tokens dropped (Python ``str.split()``)."""
    return F.filter(F.split(_c(c), f"{WS_CLASS}+"), lambda t: t != F.lit(""))


def normalized_tokens(c) -> Column:
    """Answer normaliser for EM / F1: lower-case, delete ASCII punctuation, split on
    whitespace, drop the articles and empty tokens."""
    cleaned = F.regexp_replace(F.lower(_c(c)), PUNCT_CLASS, "")
    return F.filter(
        F.split(cleaned, f"{WS_CLASS}+"),
        lambda t: (t != F.lit("")) & ~t.isin(*ARTICLES),
    )


def normalized_answer(c) -> Column:
    """The normalised answer string: normalised tokens joined by one space."""
    return F.array_join(normalized_tokens(c), " ")


def char_ngram_pattern(width: int = QUIP_WIDTH) -> str:
    """Regex whose group 1 is the ``width``-code-point window starting at every position.

    The lookahead captures the window and the trailing ``.`` consumes exactly one code
    point, so the scan is linear and never splits a surrogate pair.
    """
    return f"(?s)(?=(.{{{int(width)}}}))."


def char_ngrams(c, width: int = QUIP_WIDTH) -> Column:
    """Array of all overlapping ``width``-character n-grams, in text order (empty if shorter)."""
    return F.regexp_extract_all(_c(c), F.lit(char_ngram_pattern(width)), 1)


def first_words(c, n) -> Column:
    """The first ``n`` (int or int column) whitespace tokens joined by one space."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    return F.array_join(F.slice(whitespace_tokens(c), F.lit(1), n), " ")

"""Tokenisers and string cleaning as Column expressions (FN-01..09)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "WORD_PATTERN", "word_tokens", "glove_tokens", "word_ngrams", "strip_accents",
    "collapse_ws", "fever_unescape", "split_lines", "drop_line_number",
    "drop_last_char", "hash_mod", "hash32",
]

# The token pattern of the bag-of-words vectoriser (runs of two
# or more word characters, after lower-casing) and the characters removed by
# the word-vector tokeniser: . , ! ? \ ' "   (the hyphen is kept).
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
GLOVE_STRIP = r"""[.,!?\\'"]"""
# Bracket tokens of the wiki dump and their replacements.
FEVER_TOKENS = [("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "("), ("-RSB-", ")")]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_tokens(text) -> Column:
    """FN-02: lower-case word tokens (two or more letters / digits / '_')."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_PATTERN), 0)


def glove_tokens(text) -> Column:
    """FN-01: whitespace split, strip ``. , ! ? \\ ' "``, lower case.

    The stripped characters are never white space, so removing them from
    the whole text before splitting gives the same tokens as stripping each
    token (one regex pass per text instead of one per token).  Tokens left
    empty are dropped (they can never be in a vocabulary).
    """
    cleaned = F.lower(F.regexp_replace(_c(text), GLOVE_STRIP, ""))
    return F.filter(F.split(cleaned, r"(?U)[\s\x1c-\x1f]+"), lambda w: F.length(w) > 0)


def word_ngrams(tokens, n: int = 2) -> Column:
    """FN-03: unigrams followed by the space-joined n-grams up to ``n``.

    k-grams are built by zipping k shifted slices of the token array (one
    pass, no per-position slicing).  Pass a column reference rather than a
    tokeniser expression so the tokeniser runs once per row.
    """
    toks = _c(tokens)
    out = toks
    for k in range(2, n + 1):
        m = F.greatest(F.size(toks) - (k - 1), F.lit(0))
        g = F.slice(toks, 1, m)
        for j in range(1, k):
            g = F.zip_with(g, F.slice(toks, j + 1, m), lambda a, b: F.concat(a, F.lit(" "), b))
        out = F.concat(out, g)
    return out


def strip_accents(text) -> Column:
    """FN-04: NFKD form without combining marks, for every script.  Spark has
    no normalisation function, so whole Arrow batches go through
    ``unicodedata``; ASCII texts, the common case, pass unchanged."""
    def fold(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))

    @F.pandas_udf("string")
    def udf(texts: pd.Series) -> pd.Series:
        return texts.map(fold)

    return udf(_c(text))


def collapse_ws(text) -> Column:
    """FN-05: runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def fever_unescape(text) -> Column:
    """FN-06: dump bracket tokens back to characters."""
    out = _c(text)
    for a, b in FEVER_TOKENS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def split_lines(text) -> Column:
    """FN-07."""
    return F.split(_c(text), "\n")


def drop_line_number(line) -> Column:
    """FN-08: text after the first tab, remaining tabs become blanks.

    A line without a tab is kept whole (``instr`` gives 0).
    """
    c = _c(line)
    return F.replace(c.substr(F.instr(c, "\t") + 1, F.lit(1 << 30)), F.lit("\t"), F.lit(" "))


def drop_last_char(s) -> Column:
    """FN-09."""
    c = _c(s)
    return c.substr(F.lit(1), F.length(c) - 1)


def hash32(x) -> Column:
    """Deterministic 32-bit hash: first 8 hex digits of md5, as bigint.

    The same value is computed by any SQL engine with an md5 function, which
    keeps sampling and fixture derivations reproducible across engines.
    """
    return F.conv(F.substring(F.md5(_c(x).cast("string")), 1, 8), 16, 10).cast("bigint")


def hash_mod(x, n) -> Column:
    return hash32(x) % (n if isinstance(n, Column) else F.lit(n))

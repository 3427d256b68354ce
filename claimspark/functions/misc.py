"""Label codes, ranks, JSON, dates, paths, map overlay (FN-11, 21..28)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "NLI_CODES", "ANNOTATION_CODES", "label_code", "reciprocal_rank", "utc_stamp",
    "day_window", "path_basename", "path_stem", "path_dirname", "map_overlay",
    "drop_blank_values", "json_overlay",
]

# Class codes used across the reference.
# 0 = positive / entailment / agrees, 1 = negative / contradiction / disagrees,
# 2 = neutral / not enough info / n/a; the NLI gold value '-' maps to 3.
NLI_CODES = {"entailment": 0, "contradiction": 1, "neutral": 2, "-": 3}
ANNOTATION_CODES = {"pos": 0, "neg": 1, "na": 2}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_code(label, codes: dict[str, int], default=None) -> Column:
    """FN-11: CASE label -> code."""
    expr = None
    for k, v in codes.items():
        expr = (F.when(_c(label) == k, F.lit(v)) if expr is None else expr.when(_c(label) == k, F.lit(v)))
    return expr.otherwise(F.lit(default))


def reciprocal_rank(rank) -> Column:
    """FN-21: 1/rank, NULL when unranked."""
    return F.try_divide(F.lit(1.0), _c(rank))


def utc_stamp(ts) -> Column:
    """FN-24: ``utc-YYYYMMDD-HHMMSS`` of a timestamp (session time zone UTC)."""
    return F.date_format(_c(ts), "'utc-'yyyyMMdd-HHmmss")


def day_window(since=None, until=None, today=None) -> tuple[Column, Column]:
    """FLT-15 / FN-25: complete a one-day window from the given bounds.

    none given  -> [today - 1, today); one given -> the other is one day away.
    Bounds are ``yyyy-MM-dd`` strings or Columns.
    """
    to_d = lambda x: F.to_date(x if isinstance(x, Column) else F.lit(x))
    if since is None and until is None:
        t = to_d(today) if today is not None else F.current_date()
        return F.date_sub(t, 1), t
    if since is None:
        u = to_d(until)
        return F.date_sub(u, 1), u
    if until is None:
        s = to_d(since)
        return s, F.date_add(s, 1)
    return to_d(since), to_d(until)


def path_basename(p) -> Column:
    """FN-27."""
    return F.regexp_extract(_c(p), r"([^/]*)$", 1)


def path_dirname(p) -> Column:
    return F.regexp_extract(_c(p), r"^(.*)/[^/]*$", 1)


def path_stem(p) -> Column:
    """Basename without its last extension."""
    return F.regexp_replace(path_basename(p), r"\.[^.]*$", "")


def map_overlay(base, override) -> Column:
    """FN-28 (one level): keys of ``override`` win, other keys of ``base`` kept."""
    return F.map_zip_with(_c(base), _c(override), lambda k, a, b: F.coalesce(b, a))


def drop_blank_values(m) -> Column:
    """FLT-14: drop NULL / empty-string values from a parameter map."""
    return F.map_filter(_c(m), lambda k, v: v.isNotNull() & (v.cast("string") != ""))


def _overlaid(base, override):
    if not (isinstance(base, dict) and isinstance(override, dict)):
        return override
    return {**base, **{k: _overlaid(base[k], v) if k in base else v for k, v in override.items()}}


def json_overlay(base, override) -> Column:
    """FN-28 (any depth): two JSON objects as text merged key by key.  Values
    of ``override`` win, null and lists included; maps on both sides are
    merged, a map and anything else replace each other; new keys follow the
    old ones.  A null text counts as absent; text that is no JSON raises."""
    @F.pandas_udf("string")
    def merge(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x if y is None else y if x is None
                          else json.dumps(_overlaid(json.loads(x), json.loads(y)), ensure_ascii=False)
                          for x, y in zip(a, b)], dtype=object)

    return merge(_c(base), _c(override))

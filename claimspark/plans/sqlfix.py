"""DuckDB text of the fixture views (twins of ``plans.fixtures``) and of the
deterministic hash, used to build oracle SQL."""

from __future__ import annotations


def H(x: str) -> str:
    """First 8 hex digits of md5 as bigint (same value as ``hash32``)."""
    return f"(('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 8))::BIGINT)"


WORD_RE = r"[\p{L}\p{N}_]{2,}"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD_RE}')"


CLAIMS = """claims AS (SELECT item_id AS id, text AS canonical_sentence,
  ['src' || CAST(item_id % 3 AS VARCHAR)] AS sources, [CAST(item_id % 4 AS VARCHAR)] AS category,
  list_filter(string_split(text, chr(10)), lambda l: length(trim(l)) > 0) AS pos_variations,
  1 AS reliability_score, 'benchmark' AS origin FROM benchmark)"""

GOLD = """gold AS (SELECT doc_id AS input_id, doc_id % (SELECT count(*) FROM benchmark) AS misinfo_id,
  CAST(CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 0 ELSE 2 END AS BIGINT) AS gold_label,
  'human' AS model_id FROM labels)"""

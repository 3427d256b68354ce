"""URL filter: a trie over reversed host labels and path segments.

Each rule is (verdict, host, path).  A rule fits its host and every
subdomain of it, when the url's path starts with the rule's path.  The
longest match wins: the deeper host first, then the longer path; of an
allow and a block rule with the same host and path, block wins.

The trie is broadcast.  Its size is bounded by ``max_rules`` per trie: a
longer list is cut into several tries that are asked in turn, and the
longest of their matches wins, so no rule is dropped.

Edge cases: a null url or one without ``://`` has an empty host and path
and fits no rule; ports, user names and a final dot belong to the host text
as written; repeated rows are judged alike; an empty table gives an empty
result; extra columns are carried through unchanged by ``filter_urls``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import LOWER, UPPER

# The rules of the query's contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_ASCII_LOWER = str.maketrans(UPPER, LOWER)
_HOST_END, _PATH_END = re.compile(r"[/?#]"), re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url, both empty when there is no ``://``."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    end = m.start() if (m := _HOST_END.search(rest)) else len(rest)
    path = _PATH_END.split(rest[end:], maxsplit=1)[0]
    return rest[:end].translate(_ASCII_LOWER), path


class UrlTrie:
    """Nodes are dicts: host labels from the right, then under the key
    ``None`` a trie of whole path segments, whose key ``None`` lists the
    rules' last, possibly partial segments, longest first."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in sorted(rules, key=lambda r: r[0] != "block"):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, [])
            if all(last != e[0] for e in ends):
                ends.append((last, verdict, host, path))
                ends.sort(key=lambda e: -len(e[0]))

    def match(self, host: str, path: str) -> tuple[str, str, str] | None:
        """The longest rule that fits: (verdict, host, path)."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            best = self._on_path(node.get(None), segments) or best
        return best

    @staticmethod
    def _on_path(node: dict | None, segments: list[str]):
        best = None
        for segment in segments:
            if node is None:
                break
            best = next((e[1:] for e in node.get(None, ()) if segment.startswith(e[0])), best)
            node = node.get(segment)
        return best


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow",
                url: str = "url", max_rules: int = 200_000) -> DataFrame:
    """``pages`` with a struct column ``judged`` (host, path, rule, verdict);
    ``default`` is the verdict where no rule fits."""
    sc = pages.sparkSession.sparkContext
    tries = [sc.broadcast(UrlTrie(rules[i:i + max_rules])) for i in range(0, len(rules), max_rules)]

    def judge(urls: pd.Series) -> pd.DataFrame:
        out = []
        for u in urls:
            host, path = split_url(u)
            found = [m for t in tries if (m := t.value.match(host, path))]
            best = max(found, key=lambda m: (m[1].count("."), len(m[2]), m[0] == "block"), default=None)
            out.append((host, path, best[1] + best[2] if best else None, best[0] if best else default))
        return pd.DataFrame(out, columns=["host", "path", "rule", "verdict"])

    judged = F.pandas_udf(judge, "host string, path string, rule string, verdict string")
    return pages.withColumn("judged", judged(F.col(url)))

"""Personal data by rules and a semi-Markov conditional random field.

Base spans come from fixed patterns per kind (email, ip, card, phone).  The
field looks at zones, runs of white-space separated chunks that hold a digit
or an ``@``, cut into tokens (letters, digits, single marks).  A segmentation
of a zone is a sequence of single outside tokens and entities of 2 to
``MAX_TOKENS`` tokens; an entity is scored as a whole span: digit count,
lengths of its digit groups, separators, first and last character, the
characters around it, checksum and part ranges.  Dynamic programming over
the bounded segments chooses boundaries and kinds jointly; forward and
backward sums give the training gradient and each segment's marginal.

The field is trained in numpy on zones of a bounded, hash-drawn sample of
the documents (``sample_docs`` documents, zones of at most ``zone_chars``
characters, ``max_zones`` zones) whose labels are the base spans, plus copies
with marks dropped or changed, so that it also knows spans the patterns miss
(a phone number without its plus sign, a card number with dots).  It adds a
span where the best segmentation has one, its marginal is at least
``MIN_MARGINAL`` and it overlaps no base span.  Every zone of every whole
text is decoded; time is linear in the text.

Edge cases: null text counts as empty; texts without digits and ``@`` have no
span; repeated rows are judged alike; with no zone to learn from the field
adds nothing; empty tables give an empty result; other columns are ignored
by ``find_spans`` and kept by ``mask``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import fit_in_task

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The patterns of the query's contract.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins where a run of digits does: if it fails there, so it does further in
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOT, _BLANK = re.compile(r"[0-9@]"), re.compile(r"\s")
_NOT_DIGIT = re.compile(r"[^0-9]+")

MAX_TOKENS, MIN_MARGINAL, BUCKETS = 24, 0.95, 1 << 15
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str | None) -> list[Span]:
    """Leftmost non-overlapping pattern spans per kind, by start and kind."""
    if not text or not _HOT.search(text):
        return []
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # an address is the run of local characters before an @, and a domain
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def zones(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of chunks with a digit or @, one blank apart."""
    start = end = -2
    m = _HOT.search(text)
    while m:
        low = m.start()
        while low > max(end, 0) and not text[low - 1].isspace():
            low -= 1
        blank = _BLANK.search(text, m.end())
        high = blank.start() if blank else len(text)
        if low == end + 1 and text[end] == " ":
            end = high
        else:
            if end > 0:
                yield start, end
            start, end = low, high
        m = _HOT.search(text, end)
    if end > 0:
        yield start, end


def _kind_of(c: str) -> str:
    return "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c


class Zone:
    """Tokens, outside features and candidate segments of a zone."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [m.span() for m in _TOKEN.finditer(text)]
        self.n = len(self.tokens)
        words = [text[s:e] for s, e in self.tokens]
        digits = np.cumsum([0] + [len(w) if w.isdigit() and w.isascii() else 0 for w in words])
        ats = np.cumsum([0] + [w == "@" for w in words])
        dots = np.cumsum([0] + [w == "." for w in words])
        kinds = [_kind_of(w[0]) for w in words]
        self.outside = [self._ids([f"o:{k}", f"o:{k}{min(len(w), 20)}"]) for k, w in zip(kinds, words)]
        self.ending: dict[int, list[tuple[int, str, np.ndarray]]] = defaultdict(list)  # end: (start, kind, features)
        for i in range(self.n):
            if kinds[i] not in "9a+(" or (i and kinds[i] in "9a" and kinds[i - 1] in "9a"):
                continue
            for j in range(i + 2, min(self.n, i + MAX_TOKENS) + 1):
                if kinds[j - 1] not in "9a)" or (j < self.n and kinds[j - 1] in "9a" and kinds[j] in "9a"):
                    continue
                nd, na, no = (int(c[j] - c[i]) for c in (digits, ats, dots))
                if na == 1 and no:
                    self._add(i, j, "email", nd)
                elif na == 0 and "a" not in kinds[i:j]:
                    if no == 3 and nd <= 12:
                        self._add(i, j, "ip", nd)
                    if 7 <= nd <= 19:
                        self._add(i, j, "phone", nd)
                        self._add(i, j, "card", nd)
            if digits[i + 1] - digits[i] >= 12:  # a run of digits is one token
                self._add(i, i + 1, "card", int(digits[i + 1] - digits[i]))

    @staticmethod
    def _ids(names: list[str]) -> np.ndarray:
        return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "little") % BUCKETS
                         for x in names])

    def _add(self, i: int, j: int, kind: str, n_digits: int) -> None:
        s, e = self.tokens[i][0], self.tokens[j - 1][1]
        span, before, after = self.text[s:e], self.text[s - 1:s], self.text[e:e + 1]
        groups = re.findall(r"[0-9]+", span)
        marks = "".join(sorted(set(re.sub(r"[\w]", "", span))))
        f = ["", f"d{n_digits}", "g" + "-".join(str(len(g)) for g in groups[:8]), "m" + marks, "f" + _kind_of(span[0]),
             "l" + _kind_of(span[-1]), "b" + _kind_of(before or " "), "a" + _kind_of(after or " ")]
        if kind == "card":
            digits = "".join(groups)
            f += [f"luhn{luhn(digits)}", f"luhn{luhn(digits)}{n_digits}"]
        elif kind == "ip":
            f.append(f"small{len(groups) == 4 and all(map(_small, groups))}")
        elif kind == "email":
            name, _, host = span.partition("@")
            f = [*f[:1], *f[4:], f"local{bool(name) and set(name) <= _LOCAL}", f"host{bool(_DOMAIN.fullmatch(host))}"]
        self.ending[j].append((i, kind, self._ids([f"{kind}:{x}" for x in f])))

    def forward(self, w: np.ndarray) -> tuple[list[float], list[float], dict]:
        """Log sums over segmentations of each prefix, outside scores, and
        the segments' scores."""
        out = [float(w[f].sum()) for f in self.outside]
        scores = {(i, j, k): float(w[f].sum()) for j, segs in self.ending.items() for i, k, f in segs}
        alpha = [0.0] * (self.n + 1)
        for j in range(1, self.n + 1):
            ways = [alpha[j - 1] + out[j - 1], *(alpha[i] + scores[i, j, k] for i, k, _ in self.ending.get(j, ()))]
            top = max(ways)
            alpha[j] = top + math.log(sum(math.exp(x - top) for x in ways))
        return alpha, out, scores

    def marginals(self, w: np.ndarray) -> tuple[dict, list[float]]:
        """Probability of every segment and of every outside token."""
        alpha, out, scores = self.forward(w)
        starting = defaultdict(list)
        for i, j, k in scores:
            starting[i].append((j, k))
        beta = [0.0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            ways = [beta[i + 1] + out[i], *(beta[j] + scores[i, j, k] for j, k in starting[i])]
            top = max(ways)
            beta[i] = top + math.log(sum(math.exp(x - top) for x in ways))
        z = alpha[-1]
        return ({s: math.exp(min(0.0, alpha[s[0]] + x + beta[s[1]] - z)) for s, x in scores.items()},
                [math.exp(min(0.0, alpha[i] + out[i] + beta[i + 1] - z)) for i in range(self.n)])

    def best(self, w: np.ndarray) -> list[tuple[int, int, str]]:
        """Segments of the best segmentation."""
        value, back = [0.0] * (self.n + 1), [None] * (self.n + 1)
        for j in range(1, self.n + 1):
            value[j] = value[j - 1] + float(w[self.outside[j - 1]].sum())
            for i, k, f in self.ending.get(j, ()):
                if (x := value[i] + float(w[f].sum())) > value[j]:
                    value[j], back[j] = x, (i, j, k)
        found, j = [], self.n
        while j:
            if back[j]:
                found.append(back[j])
                j = back[j][0]
            else:
                j -= 1
        return found[::-1]


def _variants(text: str, spans: list[Span], rng: np.random.Generator) -> Iterator[tuple[str, list[Span]]]:
    """The zone, and a copy in which phone numbers lose their plus sign and
    cards have dots or blanks between groups of four."""
    yield text, spans
    if not any(k in ("phone", "card") for k, _, _ in spans):
        return
    out, moved, at = [], [], 0
    for kind, s, e in spans:
        out.append(text[at:s])
        part = text[s:e]
        if kind == "phone":
            part = part.lstrip("+")
        elif kind == "card" and part.isdigit():
            part = " .-"[rng.integers(3)].join(part[i:i + 4] for i in range(0, len(part), 4))
        begin = sum(map(len, out))
        out.append(part)
        moved.append((kind, begin, begin + len(part)))
        at = e
    yield "".join(out) + text[at:], moved


def train(rows: list[tuple[str, list[Span]]], epochs: int = 6, rate: float = 0.5, decay: float = 1e-4,
          seed: int = 7) -> np.ndarray:
    """Weights by stochastic gradient on the log likelihood (Adagrad)."""
    rng = np.random.default_rng(seed)
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    data = []
    for text, spans in rows:
        for t, gold in _variants(text, spans, rng):
            zone = Zone(t)
            starts = {s: i for i, (s, _) in enumerate(zone.tokens)}
            ends = {e: i + 1 for i, (_, e) in enumerate(zone.tokens)}
            wanted = {(starts.get(s), ends.get(e), k) for k, s, e in gold}
            if zone.ending and wanted <= {(i, j, k) for j, segs in zone.ending.items() for i, k, _ in segs}:
                data.append((zone, wanted))
    for _ in range(epochs):
        for at in rng.permutation(len(data)):
            zone, wanted = data[at]
            segment, outside = zone.marginals(w)
            inside = {x for i, j, _ in wanted for x in range(i, j)}
            ids, values = [], []
            for j, segs in zone.ending.items():
                for i, k, f in segs:
                    g = segment[i, j, k] - ((i, j, k) in wanted)
                    if abs(g) > 1e-4:
                        ids.append(f)
                        values.append(np.full(len(f), g))
            for i, f in enumerate(zone.outside):
                g = outside[i] - (i not in inside)
                if abs(g) > 1e-4:
                    ids.append(f)
                    values.append(np.full(len(f), g))
            if ids:
                touched, place = np.unique(np.concatenate(ids), return_inverse=True)
                grad = np.bincount(place, np.concatenate(values)) + decay * w[touched]
                seen[touched] += grad * grad
                w[touched] -= rate * grad / np.sqrt(seen[touched])
    return w


def _apart(spans: list[Span]) -> list[Span]:
    """Spans without overlaps, the longest first."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: s[1] - s[2]):
        if all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def fit(docs: DataFrame, sample_docs: int = 20_000, max_zones: int = 3000, zone_chars: int = 300) -> np.ndarray:
    """Train on zones of a bounded sample, in one task."""
    rate = min(1.0, sample_docs / max(docs.count(), 1))
    hot = docs.select("text").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(rate * (1 << 30))) \
        .where(F.col("text").rlike("[0-9@]"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                spans = base_spans(text)
                for s, e in zones(text):
                    if e - s <= zone_chars:
                        inner = _apart([x for x in spans if s <= x[1] and x[2] <= e])
                        out.append((text[s:e], ";".join(f"{k}:{a - s}:{b - s}" for k, a, b in inner)))
            yield pd.DataFrame(out, columns=["zone", "spans"])

    found = hot.mapInPandas(cut, "zone string, spans string")

    def learn(pdf: pd.DataFrame) -> np.ndarray:
        return train([(z, [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(";") if x)])
                      for z, s in zip(pdf["zone"], pdf["spans"])])

    rows = found.withColumn("h", F.xxhash64("zone")).orderBy("h", "zone").limit(max_zones)
    learnt = fit_in_task(rows.select("zone", "spans"), learn)
    return train([]) if learnt is None else learnt


def all_spans(text: str | None, w: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans) of a text."""
    base = base_spans(text)
    if not text or not _HOT.search(text):
        return base, base
    added = []
    for s, e in zones(text):
        zone = Zone(text[s:e])
        best = zone.best(w) if zone.ending else ()
        if best:
            sure, _ = zone.marginals(w)
            for i, j, kind in best:
                a, b = s + zone.tokens[i][0], s + zone.tokens[j - 1][1]
                if sure[i, j, kind] >= MIN_MARGINAL and all(b <= x[1] or a >= x[2] for x in base):
                    added.append((kind, a, b))
    return base, sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]))) if added else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def _columns(text: str | None, w: np.ndarray) -> tuple:
    base, every = all_spans(text, w)
    counts = [sum(k == x[0] for x in base) for k in KINDS]
    return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)


def find_spans(docs: DataFrame, w: np.ndarray | None = None) -> DataFrame:
    """(doc_id, base counts, base_sha256, spans) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs) if w is None else w)

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_columns(t, shared.value) for t in texts], columns=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select("doc_id", found(F.col("text")).alias("f")).select("doc_id", "f.*")


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or run of overlapping spans, as [KIND]."""
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask_column(text: Column, w, spark) -> Column:
    shared = spark.sparkContext.broadcast(w)

    @F.pandas_udf("string")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(t, all_spans(t, shared.value)[1]) for t in texts], dtype=object)

    return udf(text)


def mask(docs: DataFrame, w: np.ndarray | None = None) -> DataFrame:
    """``docs`` with personal data masked; ``n_chars`` follows if present."""
    out = docs.withColumn("text", mask_column(F.col("text"), fit(docs) if w is None else w, docs.sparkSession))
    if "n_chars" in docs.columns:
        same = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        out = out.withColumn("n_chars", same)
    return out.select(*docs.columns)

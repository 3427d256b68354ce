"""SimHash near-duplicates by tiled exact comparison.

A text's words (split at ASCII white space, A-Z lower-cased) form shingles
of ``shingle`` consecutive words, repeats included; fewer words make one
shingle.  A fingerprint bit is set if it is set in over half of the
shingles' XXH64 values; no words give fingerprint 0.

Distinct fingerprints are compared, not documents: copies share one.  A
fingerprint's tile is the vector of population counts of its ``blocks``
equal parts.  Two fingerprints at distance d have population counts whose
differences sum to d at most, so a tile is compared only with itself and the
tiles within ``radius`` of it, and every other tile pair is skipped without
loss.  Each fingerprint visits the tiles above its own (by vector order), so
a pair meets once.  A tile with more than ``tile_rows`` members is cut into
parts, visitors go to each part, and parts of one tile visit each other; a
task holds one part and streams its visitors against it in fixed chunks of
numpy exclusive-or and bit counts.

A task reduces the links inside a tile to a spanning forest, so a large
group of near copies never emits all its pairs and components lose no link.
Work grows with the square of the fingerprints times the share of tile pairs
within the radius; more ``blocks`` lower the share and raise the visits.  Four
blocks compare 1.6 % of the pairs with 20 visits per fingerprint, eight 0.03 %
with 72 (radius 2, random fingerprints); ``blocks=None`` takes eight beyond
``FEW_PRINTS`` distinct fingerprints.  The links are the same either way.

Edge cases: null and empty texts have fingerprint 0 and link like any
other; repeated rows share a fingerprint; rows with a null doc_id take part
but never name a component unless it holds no other id (then null); empty
tables give an empty result; extra columns are ignored by the search and
kept by ``keep_one_per_group``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import connected_components, materialise


FEW_PRINTS = 4_000_000


def simhash(text: str | None, shingle: int) -> int:
    """The 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - shingle + 1]
        shingles = [joined[s:e] for s, e in zip(starts.tolist(), ends[shingle - 1:].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 1 << 16):  # bounded blocks of a very long text
        part = shingles[i:i + (1 << 16)]
        h = np.fromiter((xxh64_intdigest(s, 42) for s in part), "<u8", len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int) -> Column:
    """Fingerprint as a signed 64-bit column."""
    @F.pandas_udf("bigint")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))
    return udf(text)


def tile_key(fp: Column, blocks: int) -> Column:
    """Population counts of the blocks as one integer in base 65."""
    width = 64 // blocks
    key = F.lit(0).cast("bigint")
    for b in range(blocks):
        mask = ((1 << width) - 1) << (b * width)
        mask -= (1 << 64) if mask >> 63 else 0
        key = key * 65 + F.bit_count(fp.bitwiseAND(F.lit(mask).cast("bigint")))
    return key


def upper_steps(blocks: int, radius: int) -> list[int]:
    """Key differences to the tiles above a tile within the radius.  A step
    that leaves the range 0..width of a block names a tile nobody lives in:
    in base 65 it cannot reach another block's valid counts by a carry."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=blocks) if 0 < sum(map(abs, d)) <= radius]
    values = []
    for d in steps:
        v = 0
        for x in d:
            v = v * 65 + x
        values.append(v)
    return sorted(v for v in values if v > 0)


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spanning edges of the links (a[i], b[i]) between node indices: each
    linked node with the smallest index of its component."""
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[own], nodes[label[own]]], axis=1)


def _compare(base: np.ndarray, visitors: np.ndarray, inner: bool, radius: int, chunk: int = 1 << 21) -> np.ndarray:
    """Spanning edges of the links between a tile part and some visitors
    (or inside the part), from blocks of at most ``chunk`` comparisons."""
    other = base if inner else visitors
    step = max(1, chunk // max(1, len(base)))
    found_a, found_b, edges = [], [], []
    nodes = base if inner else np.concatenate([base, other])
    shift = 0 if inner else len(base)
    for i in range(0, len(other), step):
        near = np.bitwise_count(other[i:i + step, None] ^ base[None, :]) <= radius
        y, x = np.nonzero(near)
        y += i
        if inner:
            y, x = y[y > x], x[y > x]
        found_a.append(x)
        found_b.append(y + shift)
        if sum(map(len, found_a)) > chunk:  # keep links bounded too
            edges.append(_forest(nodes, np.concatenate(found_a), np.concatenate(found_b)))
            found_a, found_b = [], []
    if found_a:
        edges.append(_forest(nodes, np.concatenate(found_a), np.concatenate(found_b)))
    return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def near_edges(fps: DataFrame, radius: int, blocks: int = 4, tile_rows: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) at most
    ``radius`` bits apart, reduced to a spanning forest per tile part."""
    spark = fps.sparkSession
    keyed = fps.select("fp", tile_key(F.col("fp"), blocks).alias("tile"))
    # at most (64 / blocks + 1)^blocks tiles exist: 83 521 for four blocks
    parts = keyed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).cast("int").alias("parts"))
    if (64 // blocks + 1) ** blocks <= 200_000:
        parts = F.broadcast(parts)
    part_of = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    home = keyed.join(parts, "tile").withColumn("part", part_of)
    base = home.select("tile", "part", "fp", F.lit(0).alias("role"))
    own = (home.where("part > 0").select("tile", "fp", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("part"))
           .select("tile", "part", "fp", F.lit(1).alias("role")))
    steps = F.array(*[F.lit(s).cast("bigint") for s in upper_steps(blocks, radius)])
    visits = (keyed.select("fp", F.explode(F.transform(steps, lambda s: F.col("tile") + s)).alias("tile"))
              .join(parts, "tile").select("tile", "fp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
              .select("tile", "part", "fp", F.lit(1).alias("role")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    meet = (base.unionByName(own).unionByName(visits).repartition(n, "tile", "part")
            .sortWithinPartitions("tile", "part", "role"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, members, done = None, [], True

        def edges_of(out: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"a": out[:, 0].view(np.int64), "b": out[:, 1].view(np.int64)})

        for pdf in batches:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            place = pdf[["tile", "part", "role"]].to_numpy()
            role = place[:, 2]
            runs = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)])
            for s, e in zip(runs, np.r_[runs[1:], len(place)]):
                if tuple(place[s, :2]) != key:
                    if key is not None and not done:
                        yield edges_of(_compare(np.concatenate(members), None, True, radius))
                    key, members, done = tuple(place[s, :2]), [], True
                if role[s] == 0:
                    members.append(fp[s:e])
                    done = False
                    continue
                tile = np.concatenate(members)
                if not done:
                    yield edges_of(_compare(tile, None, True, radius))
                    members, done = [tile], True
                yield edges_of(_compare(tile, fp[s:e], False, radius))
        if key is not None and not done:
            yield edges_of(_compare(np.concatenate(members), None, True, radius))

    return meet.select("tile", "part", "role", "fp").mapInPandas(compare, "a bigint, b bigint")


def _grouped(docs: DataFrame, shingle: int, radius: int, blocks: int | None) -> DataFrame:
    """(doc_id, fp, component, component_id) of every document row;
    ``component`` is a fingerprint that names the group."""
    prints = materialise(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")), "simhash")
    lowest = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
    blocks = blocks or (4 if lowest.count() <= FEW_PRINTS else 8)
    groups = connected_components(near_edges(lowest.select("fp"), radius, blocks))
    named = (lowest.join(groups, lowest["fp"] == groups["node"], "left")
             .select("fp", "low", F.coalesce("component", "fp").alias("component")))
    smallest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of_print = named.join(smallest, "component").select("fp", "component", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every document row."""
    return _grouped(docs, shingle, radius, blocks).drop("component")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_per_group(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The row with the smallest id of each group; where several rows of the
    group have that id, the one with the smallest fingerprint and text.  Rows
    of one id in different groups are judged each in its own group, and a
    group without any id keeps one row."""
    groups = materialise(_grouped(docs, shingle, radius, None), "groups")
    unclear = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or doc_id is null")
    unclear = materialise(unclear.select("doc_id"), "unclear")
    same_id = docs["doc_id"].eqNullSafe(unclear["doc_id"])
    drop = groups.where("doc_id <> component_id").select("doc_id").distinct()
    if not unclear.limit(1).count():
        return docs.join(drop, docs["doc_id"] == drop["doc_id"], "left_anti")
    clear = docs.join(unclear, same_id, "left_anti").join(drop, docs["doc_id"] == drop["doc_id"], "left_anti")
    # the id does not tell these rows apart, so they find their group by their fingerprint
    rows = docs.join(unclear, same_id, "left_semi").select(
        F.struct("*").alias("row"), fingerprint(F.col("text"), shingle).alias("fp"))
    place = (groups.where("doc_id <=> component_id").join(unclear, groups["doc_id"].eqNullSafe(unclear["doc_id"]),
                                                          "left_semi")
             .select(F.col("doc_id").alias("id"), F.col("fp").alias("print"), "component").distinct())
    first = (rows.join(place, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("print")))
             .groupBy("component").agg(F.min_by("row", F.struct("fp", "row.text")).alias("row")))
    return clear.unionByName(first.select("row.*"))

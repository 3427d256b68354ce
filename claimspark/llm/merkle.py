"""Merkle manifest of a table by lag and lead windows.

A row's leaf is the hash of its fields, each with its length.  Per group,
leaves in order make a tree of ``FAN`` children a node, and the groups' roots
in order make another one above, whose root names the whole table.  On each
level, lag and lead columns at the fixed offsets 1 to ``FAN - 1``, masked by
a node's slot in its run and by the run's length, hold a node's siblings; the
first child of a run hashes its parent from its own and its leads.  A level
has an eighth of the rows of the one below, so the work is that of the
leaves.  From the top down, each node then gets the siblings of its path to
the root, its proof.

A window spans one run, so a group of any size spreads over all tasks; the
places of the leaves come from ``ranked``, and a node's siblings meet its
parent's path in the window's own partitioning.  Levels are written to the
shared scratch folder.

H is the lower-case hex SHA-256 of its inputs, put together; digests enter as
hex text.  A run of one node has a parent too; a group of one leaf has that
leaf as its root.  Nulls count as ``-``, which no value with a length can be.

Edge cases: null doc_ids come first in their group, null groups before the
others; rows that repeat are leaves of their own, ordered by leaf within
equal ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimspark.llm.common import materialise, ranked

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: list[Column]) -> Column:
    def field(c: Column) -> Column:
        c = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return digest(*map(field, fields))


def siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (g, n, i, digest, ...) with ``run`` and the run's digests before
    (``left``) and after (``right``) their own."""
    nodes = nodes.withColumn("run", F.expr(f"i div {FAN}"))
    slot = F.col("i") % FAN
    length = F.least(F.lit(FAN), F.col("n") - F.col("run") * FAN)
    w = Window.partitionBy("g", "run").orderBy("i")
    left = [F.when(slot >= j, F.lag("digest", j).over(w)) for j in range(FAN - 1, 0, -1)]
    right = [F.when(slot + j < length, F.lead("digest", j).over(w)) for j in range(1, FAN)]
    return nodes.select("*", F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right"))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level up, hashed by the first child of each run."""
    return siblings(nodes).where(F.col("i") % FAN == 0).select(
        "g", F.ceil(F.col("n") / FAN).alias("n"), F.col("run").alias("i"),
        digest(F.col("digest"), F.col("right")).alias("digest"))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (g, n, i, digest), their parents and so on; each level holds
    the groups that have more than one node on the level below."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(materialise(parents(out[-1].where("n > 1")), "level"))
        most = -(-most // FAN)
    return out


PATH = "array<struct<left:string,right:string>>"


def with_path(nodes: DataFrame, above: DataFrame | None, tops: DataFrame) -> DataFrame:
    """Nodes of one level with ``path``, the siblings of each ancestor's and
    their own, and ``subroot``: from the level ``above`` or, for a group's
    only node, from ``tops`` (g, subroot, path)."""
    alone = nodes.where("n = 1").join(tops, "g")
    if above is None:
        return alone
    over = above.select("g", F.col("i").alias("run"), "subroot", F.col("path").alias("rest"))
    inner = siblings(nodes.where("n > 1")).join(over, ["g", "run"])
    return inner.withColumn("path", F.concat(F.array(F.struct("left", "right")), "rest")) \
        .select(*alone.columns).unionByName(alone)


def descend(tree: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves of a tree with their paths."""
    above = None
    for nodes in reversed(tree):
        above = with_path(nodes, above, tops)
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, start, lambda d, s: digest(s["left"], d, s["right"]))


def proof(path: Column) -> Column:
    """All siblings of a path, from the leaf's to those below the root, left
    to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, seen_leaf, subroot, root, path) of every row of
    documents.  ``changed`` gives other contents of some fields, as a later
    reader may see them: ``seen_leaf`` is the leaf of these."""
    changed = changed or {}
    rows = materialise(docs.select(
        "doc_id", "lang", leaf([F.col(c) for c in FIELDS]).alias("digest"),
        leaf([changed.get(c, F.col(c)) for c in FIELDS]).alias("seen")), "leaves")
    leaves = ranked(rows, "lang", ["doc_id", "digest"]).drop("lang")
    leaves = materialise(leaves.withColumnsRenamed({"_g": "g", "_n": "n", "_i": "i"}), "leaves")
    tree = levels(leaves)
    roots = [nodes.where("n = 1").select("g", "digest") for nodes in tree]
    roots = materialise(reduce(DataFrame.unionByName, roots), "roots")
    n_groups = roots.count()
    upper = levels(roots.select(F.lit(0).cast("bigint").alias("g"), F.lit(n_groups).cast("bigint").alias("n"),
                                F.col("g").alias("i"), "digest"))
    top = upper[-1].first()
    root = F.lit(top["digest"] if top else None).cast("string")
    only = upper[-1].select("g", root.alias("subroot"), F.array().cast(PATH).alias("path"))
    tops = descend(upper, only).select(F.col("i").alias("g"), F.col("digest").alias("subroot"), "path")
    return descend(tree, materialise(tops, "tops")).select(
        "doc_id", F.col("digest").alias("leaf"), F.col("seen").alias("seen_leaf"), "subroot", root.alias("root"), "path")


def verify(docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """The manifest with ``proof_sha256``, ``folded_root`` (from what was
    seen) and ``verified``."""
    return manifest(docs, changed).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
        fold(F.col("seen_leaf"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))

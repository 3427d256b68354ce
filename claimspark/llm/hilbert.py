"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to ``bits`` bits each, a row's
cell gets its index on the Hilbert curve, rows are sorted by that index and
the order is cut into runs.  Neighbours on the curve are neighbours in every
dimension, so a shard spans a small box and files can be pruned by any of
them.  Names are quantised by rank: a name's cell is the share of rows whose
names come before it, so cells follow the names' order (and a file's minimum
and maximum prune) and hold about equally many rows.  Built-in functions only.

Law ``rows``: shard sizes differ by at most one row.  The exact rank comes
from a range partitioning, the row index inside each partition and a running
sum over one count per partition; the sorted metadata (never the texts) are
written once to the shared scratch folder, so ranks stay fixed if tasks
re-run.  Equal cells are cut anywhere: a hot source or group of copies
spreads over several partitions and shards.

Edge cases: null text counts as empty with size 16 and CRC 0; null lang and
source come before all names; names so rare that they share a cell stay
neighbours; repeated rows get slots of their own; an empty table gives an
empty result; extra columns are ignored by ``shard`` and written by
``write_shards``, whose folder column takes another name if theirs clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimspark.llm.common import materialise, ranked


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint")


def _crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("bigint")


def name_bounds(docs: DataFrame, cols: list[str], bits: int) -> DataFrame:
    """One row with a column per name column: an array of at most 2^bits
    (cell, first name of the cell), ascending.  The names' counts come from
    one aggregate over the rows; their running sums from a range partitioning
    of the distinct names and one row per partition, so no task holds all."""
    entries = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(c).cast("string").alias("name"))
                        for i, c in enumerate(cols)])
    counts = materialise(docs.select(F.explode(entries).alias("e")).groupBy("e.dim", "e.name")
                         .agg(F.count(F.lit(1)).alias("n")), "names")
    placed = materialise(counts.repartitionByRange("dim", "name").withColumn("_part", F.spark_partition_id()), "names")
    parts = placed.groupBy("dim", "_part").agg(F.sum("n").alias("_n"))  # one row per partition, two at most
    before = F.sum("_n").over(Window.partitionBy("dim").orderBy("_part")) - F.col("_n")
    parts = parts.select("dim", "_part", before.alias("_before"),
                         F.sum("_n").over(Window.partitionBy("dim")).alias("_total"))
    within = Window.partitionBy("dim", "_part").orderBy(F.col("name").asc_nulls_first())
    upto = F.col("_before") + F.sum("n").over(within) - F.col("n")
    cells = (placed.join(F.broadcast(parts), ["dim", "_part"])
             .select("dim", "name", F.floor(upto * (1 << bits) / F.col("_total")).cast("int").alias("cell"))
             .where("name is not null").groupBy("dim", "cell").agg(F.min("name").alias("name")))
    return cells.agg(*[F.sort_array(F.collect_list(F.when(F.col("dim") == i, F.struct("cell", "name")))).alias(f"_b{i}")
                       for i in range(len(cols))])


def quantise_name(c: Column, bounds: Column) -> Column:
    """A name's cell: the last one that begins at or before it; 0 for null."""
    begun = F.filter(bounds, lambda b: b["name"] <= c.cast("string"))
    return F.coalesce(F.get(begun, F.size(begun) - 1)["cell"], F.lit(0))


def quantise_size(size: Column, bits: int) -> Column:
    """Half-octave cells of a positive number: the position of its highest
    bit and the bit below it; sizes beyond the last cell fall into it."""
    top = F.length(F.bin(size)) - 1
    half = F.call_function("shiftright", size, F.greatest(top - 1, F.lit(0))).bitwiseAND(F.lit(1))
    return F.least(F.lit((1 << bits) - 1), (top * 2 + half)).cast("int")


def hilbert_index(df: DataFrame, dims: list[str], bits: int, out: str = "curve") -> DataFrame:
    """Add the Hilbert index of the integer columns ``dims`` (each below
    2^bits).  From the highest bit down, a cell's coordinates are reflected
    or exchanged with the first so that each quadrant's sub-curve joins its
    neighbours; the Gray code of the result gives the index bits."""
    xs = [f"_x{i}" for i in range(len(dims))]
    df = df.select("*", *[F.col(d).cast("bigint").alias(x) for d, x in zip(dims, xs)])
    first = F.col(xs[0])
    for level in range(bits - 1, 0, -1):
        low = F.lit((1 << level) - 1).cast("bigint")
        for x in xs:
            flip = F.col(x).bitwiseAND(F.lit(1 << level)) != 0
            swap = first.bitwiseXOR(F.col(x)).bitwiseAND(low)
            df = df.withColumn("_s", F.when(flip, F.lit(0)).otherwise(swap).cast("bigint")) \
                   .withColumns({xs[0]: F.when(flip, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(F.col("_s")))}
                                | ({x: F.col(x).bitwiseXOR(F.col("_s"))} if x != xs[0] else {}))
    for before, x in zip(xs, xs[1:]):
        df = df.withColumn(x, F.col(x).bitwiseXOR(F.col(before)))
    turn = F.lit(0).cast("bigint")
    for level in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(xs[-1]).bitwiseAND(F.lit(1 << level)) != 0,
                                      F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_s", turn).withColumns({x: F.col(x).bitwiseXOR(F.col("_s")) for x in xs})
    index = F.lit(0).cast("bigint")
    for level in range(bits - 1, -1, -1):
        for x in xs:
            index = index * 2 + F.call_function("shiftright", F.col(x), F.lit(level)).bitwiseAND(F.lit(1))
    return df.withColumn(out, index).drop("_s", *xs)


def shard(docs: DataFrame, n_shards: int = 40, bits: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, curve, law, shard, slot) of every row."""
    spark = docs.sparkSession
    bounds = name_bounds(docs, ["lang", "source"], bits)  # one row of at most 2^bits names a column
    meta = docs.select(
        "doc_id", text_size(F.col("text")).alias("size"), _crc(F.col("text")).alias("text_crc32"),
        F.struct("lang", "source").alias("_names")).crossJoin(F.broadcast(bounds))
    meta = meta.select("doc_id", "size", "text_crc32", quantise_name(F.col("_names.lang"), F.col("_b0")).alias("_lang"),
                       quantise_name(F.col("_names.source"), F.col("_b1")).alias("_source"))
    meta = meta.withColumn("_size", quantise_size(F.col("size"), bits))
    meta = hilbert_index(meta, ["_lang", "_source", "_size"], bits).drop("_lang", "_source", "_size")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "text_crc32", "doc_id", "_tie"]
    index = F.monotonically_increasing_id()
    ranked = materialise(
        meta.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n_parts, *order)
            .sortWithinPartitions(*order).drop("_tie")
            .withColumn("_part", F.call_function("shiftright", index, F.lit(33)))
            .withColumn("_at", index.bitwiseAND(F.lit((1 << 33) - 1))), "curve")
    counts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    total = F.sum("_n").over(Window.partitionBy())
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = counts.select("_part", before.alias("_before"), total.alias("_total"))
    rank, n = F.col("_before") + F.col("_at"), F.col("_total")
    return (ranked.join(F.broadcast(offsets), "_part")
            .withColumn("_rank", rank)
            .withColumn("shard", F.expr(f"(_rank * {n_shards}) div _total").cast("int"))
            .withColumn("slot", F.col("_rank") - F.expr(f"(shard * _total + {n_shards - 1}) div {n_shards}"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", "curve"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, bits: int = 6) -> str:
    """Write the documents themselves, one folder per shard, each file a run
    of slots, and return the name of the folder column.

    Rows meet their place by id and CRC.  Equal rows lie side by side in the
    order of shards, so at most ``n_shards - 1`` sets of them are cut by a
    border; only those are numbered (a hot set spread over tasks) to give
    each shard its count.  Equal CRCs of one id with unequal texts count as
    equal here: shards still get their counts, as many rows in all."""
    n = docs.count()
    place = materialise(shard(docs, n_shards, bits).groupBy("doc_id", "text_crc32").agg(
        F.min(F.struct("shard", "slot")).alias("first"), F.max("shard").alias("last")), "places")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), _crc(F.col("text")).alias("_crc"))
    both = rows.join(place, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_crc") == F.col("text_crc32"))) \
        .select("row", "_id", "_crc", "first", "last")
    whole = both.where("first.shard = last").select("row", F.col("last").alias("shard"), F.col("first.slot").alias("slot"))
    cut = both.where("first.shard <> last").withColumn("_key", F.to_json(F.struct("_id", "_crc")))
    rank = F.expr(f"(first.shard * {n} + {n_shards - 1}) div {n_shards} + first.slot + _i") if n else F.lit(0)
    cut = ranked(materialise(cut, "cut"), "_key", []).withColumn("_rank", rank)
    cut = cut.withColumn("shard", F.expr(f"(_rank * {n_shards}) div {max(n, 1)}").cast("int")) \
             .select("row", "shard", F.lit(0).cast("bigint").alias("slot"))
    column = "shard"
    while column.lower() in [c.lower() for c in docs.columns]:
        column += "_"
    (whole.unionByName(cut).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .select("row.*", F.col("shard").alias(column)).write.partitionBy(column).parquet(path))
    return column

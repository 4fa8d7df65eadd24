"""Shards cut from a Hilbert-curve order of document metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize


def hilbert_cells(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """cell, curve: the Hilbert index of each of the 2**(dims*bits) cells.

    A cell packs the coordinates, first dimension highest. The fold below is the usual
    axes-to-transpose walk: from the top bit down, invert or exchange low bits of the axes,
    then Gray-decode and interleave.
    """
    axes = F.array(*[F.shiftright("cell", bits * (dims - 1 - d)).bitwiseAND((1 << bits) - 1) for d in range(dims)])
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(d).alias("d")) for b in range(bits - 1, 0, -1) for d in range(dims)])

    def turn(x: Column, s: Column) -> Column:
        low = s.q - 1
        mine = F.element_at(x, s.d + 1)
        swap = x[0].bitwiseXOR(mine).bitwiseAND(low)
        invert = F.transform(x, lambda v, i: F.when(i == 0, v.bitwiseXOR(low)).otherwise(v))
        exchange = F.transform(x, lambda v, i: F.when(s.d == 0, v).when((i == 0) | (i == s.d), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(mine.bitwiseAND(s.q) != 0, invert).otherwise(exchange)

    walked = spark.range(1 << (dims * bits)).select(F.col("id").cast("int").alias("cell"))
    walked = walked.withColumn("x", F.aggregate(steps, axes, turn) if bits > 1 else axes)
    coded = [F.col("x")[0]]
    for d in range(1, dims):
        coded.append(F.col("x")[d].bitwiseXOR(coded[-1]))
    walked = walked.withColumn("g", F.array(*coded))
    last = F.element_at("g", dims)
    tops = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    flip = F.aggregate(tops, F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)) if bits > 1 else F.lit(0)
    walked = walked.withColumn("t", flip)
    index = F.lit(0)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            index = index * 2 + F.shiftright(F.col("g")[d].bitwiseXOR(F.col("t")), b).bitwiseAND(1)
    return walked.select("cell", index.alias("curve"))


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
#: Rows of a cell that one task orders, on average.
PART_ROWS = 1 << 16


def _cuts(rows: DataFrame, name: str, cells: int) -> list[tuple[int, object]]:
    """(step, least value of the step) at the quantiles of a column of any type that has an order.

    Rows are counted per value, which combines before the shuffle; values are dealt out in ranges,
    and running sums over ranges and inside them give the share of rows before each value. Only
    the steps' least values reach the driver, ``cells`` of them at most.
    """
    counts = rows.groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = materialize(counts.repartitionByRange("v").withColumn("pid", F.spark_partition_id()), "shard-values")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = ranged.groupBy("pid").agg(F.sum("n").alias("w")).withColumn("w0", F.coalesce(F.sum("w").over(before), F.lit(0)))
    total = ranged.agg(F.sum("n")).first()[0] or 1
    inside = Window.partitionBy("pid").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("w1")
    placed = ranged.select("pid", "v", share).join(F.broadcast(sums), "pid")
    step = F.expr(f"cast((w0 + w1) * {cells} div {total} as int)")
    found = placed.where("v is not null").groupBy(step.alias("step")).agg(F.min("v").alias("least")).collect()
    return sorted((r["step"], r["least"]) for r in found)


def hilbert_shards(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source", "n_chars"),
    law: str = "bytes", bits: int = 4,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve for every row.

    Each dimension is quantised at its quantiles to 2**bits steps (numbers at approximate ones,
    all else in the order of the whole value), the rows are put in Hilbert order of the cells,
    and the order is cut into runs. Law ``rows`` cuts runs whose counts differ by one at most;
    law ``bytes`` cuts where the running size passes a multiple of the mean, so runs differ by
    the largest row at most. Inside a cell rows are ordered by a hash, whose top bits divide the
    cell into as many parts as its rows need, so no task orders a whole large cell. Offsets are
    summed over cells (at most 2**(dims*bits) rows), then over the parts of one cell.

    Size is the UTF-8 length plus 1; a null text counts as empty. Null dimensions sort first.
    Equal texts may lie in different shards, as their metadata may differ. Repeated rows each get
    their own slot. A long text is a large row: under law ``bytes`` shards differ by the largest at
    most. Ties in the hash go by id and text. Other columns are ignored. An empty table gives an empty result.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law must be rows or bytes")
    spark, kinds, cells = docs.sparkSession, dict(docs.dtypes), 1 << bits
    text = F.coalesce(F.col(text_col), F.lit(""))
    numeric = [kinds[c].startswith(NUMBERS) for c in dims]
    codes = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *[(F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) if number else F.col(c)).alias(f"d{i}") for i, (c, number) in enumerate(zip(dims, numeric, strict=True))],
    )
    codes = materialize(codes, "shard-codes")
    at = [i / cells for i in range(1, cells)]
    cell = F.lit(0)
    for i, number in enumerate(numeric):
        step = F.lit(0)
        if number:
            cuts = codes.agg(F.percentile_approx(f"d{i}", at, 10_000)).first()[0] or []  # a few cut points
            for j, cut in enumerate(sorted(set(cuts))):
                step = F.when(F.col(f"d{i}") > cut, j + 1).otherwise(step)
        else:
            for j, least in _cuts(codes, f"d{i}", cells):
                step = F.when(F.col(f"d{i}") >= least, j).otherwise(step)
        cell = cell * cells + step
    mixed = F.xxhash64("doc_id", "text_crc32", "size")
    keyed = codes.select("doc_id", "size", "text_crc32", cell.alias("cell"), mixed.alias("h"))
    counts = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    sub_bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / PART_ROWS))).cast("int").alias("sub_bits")
    known = hilbert_cells(spark, len(dims), bits).join(counts, "cell").select("cell", "curve", sub_bits)
    keyed = keyed.join(F.broadcast(known), "cell").drop("cell")
    keyed = keyed.withColumn("sub", F.expr("if(sub_bits = 0, 0, cast(shiftrightunsigned(h, 64 - sub_bits) as int))"))
    weight = F.lit(1) if law == "rows" else F.col("size")
    parts = keyed.groupBy("curve", "sub").agg(F.sum(weight).cast("long").alias("w"), F.count(F.lit(1)).alias("n"))
    parts = materialize(parts, "shard-parts")
    runs = parts.groupBy("curve").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("curve", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    w_all, n_all = parts.agg(F.sum("w"), F.sum("n")).first()
    inside = Window.partitionBy("curve").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("curve", "sub", F.coalesce(F.sum("w").over(inside), F.lit(0)).alias("w1"), F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n1"))
    offsets = offsets.join(F.broadcast(runs), "curve").select("curve", "sub", (F.col("w0") + F.col("w1")).alias("w0"), (F.col("n0") + F.col("n1")).alias("n0"))
    order = Window.partitionBy("curve", "sub").orderBy(F.col("h") < 0, "h", "doc_id", "text_crc32")  # as unsigned numbers
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(offsets, ["curve", "sub"])
    placed = placed.withColumn("rank", F.col("n0") + F.row_number().over(order) - 1)
    if law == "rows":
        # shard s holds ranks ceil(s*n/k) to ceil((s+1)*n/k) - 1
        shard = F.expr(f"cast(rank * {shards} div {n_all or 1} as int)")
        placed = placed.withColumn("shard", shard).withColumn("slot", F.expr(f"rank - (shard * {n_all or 0} + {shards - 1}) div {shards}"))
    else:
        placed = placed.withColumn("w", F.col("w0") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
        placed = placed.withColumn("shard", F.expr(f"cast(least({shards - 1}, (w + size div 2) * {shards} div {w_all or 1}) as int)"))
        placed = materialize(placed, "shard-cuts")
        first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
        placed = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first"))
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 16, files: int = 8, id_col: str = "doc_id", text_col: str = "text", **how: object) -> str:
    """Writes ``docs`` with all their columns below ``path``, a folder per shard; returns the folders' column.

    Each shard's rows are written in curve order as about ``files`` files, so the files' least and
    greatest values of every dimension prune scans. Rows that repeat id and text share their
    places among themselves. Nulls, long texts and empty tables are as in ``hilbert_shards``. The column is ``shard``, with underscores behind it if docs have one.
    """
    name = "shard"
    while name in docs.columns:
        name += "_"
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = ["doc_id", "size", "text_crc32"]
    placed = hilbert_shards(docs, shards, id_col, text_col, **how).select(*key, "shard", "slot")
    mine = own.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))).alias("a")
    place = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot"))).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    for c in ("size", "text_crc32", "nth"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    met = mine.join(place, same).select("a.row", "b.shard", "b.slot")
    dealt = met.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name

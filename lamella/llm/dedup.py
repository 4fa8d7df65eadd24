"""Exact deduplication over an extendible-hash index on shared files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: Parts in which the copies of one text are counted before they meet at its owner.
PARTIALS = 16
#: Repeated keys that are broadcast at most (16 bytes each or so); more of them meet the texts in a shuffle.
BROADCAST_KEYS = 500_000


@dataclass(frozen=True)
class Index:
    """The tables of an index on shared files.

    codes: doc_id, key, text_sha256 of every row. cells: cell, bucket, local_depth, the directory
    of ``depth`` leading bits. entries: bucket, local_depth, key, chain, text_sha256, keep_id,
    group_size, one row per different text.
    """

    codes: DataFrame
    cells: DataFrame
    depth: int
    entries: DataFrame


def _norm(text_col: str) -> Column:
    return lower_ascii(F.coalesce(F.col(text_col), F.lit("")))


def _prefix(depth: int) -> Column:
    """The ``depth`` leading bits of the key, as a number."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_rows: int) -> tuple[DataFrame, int]:
    """(cells, depth): the extendible-hash directory of distinct ``keys``.

    It starts with the fewest buckets whose mean load may fit. Then, round by round, each bucket
    with more than ``bucket_rows`` keys splits in two and the directory doubles, until no bucket
    is overfull. A round counts the keys of the buckets still open, combined before the shuffle,
    and writes their loads to shared files. Distinct keys differ in some bit, so it ends.
    """
    depth = max(0, (keys.count() // bucket_rows).bit_length() - 1)
    live, closed = keys.select("key"), []
    while True:
        loads = materialize(live.groupBy(_prefix(depth).alias("prefix")).agg(F.count(F.lit(1)).alias("load")), "dedup-loads")
        closed.append(loads.where(F.col("load") <= bucket_rows).select("prefix", F.lit(depth).alias("local_depth")))
        over = loads.where(F.col("load") > bucket_rows).select("prefix")
        if not over.limit(1).count():
            break
        live = live.withColumn("prefix", _prefix(depth)).join(over, "prefix", "left_semi").select("key")
        depth += 1
    buckets = closed[0]
    for more in closed[1:]:
        buckets = buckets.union(more)
    first = F.expr(f"shiftleft(prefix, {depth} - local_depth)")
    spans = buckets.select("local_depth", first.alias("bucket"), F.expr(f"shiftleft(1L, {depth} - local_depth)").alias("slots"))
    cell = F.explode(F.sequence(F.col("bucket"), F.col("bucket") + F.col("slots") - 1))
    return materialize(spans.select(cell.alias("cell"), "bucket", "local_depth"), "dedup-directory"), depth


def _placed(rows: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """``rows`` with the bucket that the directory gives their key."""
    return rows.withColumn("cell", _prefix(depth)).join(cells, "cell").drop("cell")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 4096) -> Index:
    """Indexes every row of ``docs`` by its normalised text.

    Keys are 64-bit hashes. A key that one row alone has is an entry without its text. The texts
    of all other keys go to their buckets, copies being counted in up to PARTIALS parts before
    the shuffle, so a text that fills a third of the rows is some rows per task; texts of other keys
    aren't shuffled while the repeated keys are few enough to be broadcast. Each owner task then takes a range of (bucket, key): it lines up the texts of a key, compares neighbours
    byte by byte, opens a new link of the chain wherever they differ, and writes the links with
    their largest id and number of rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _norm(text_col).alias("norm")).withColumn("key", F.xxhash64("norm"))
    codes = materialize(rows.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "dedup-codes")
    keys = codes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"), F.min("text_sha256").alias("text_sha256"))
    keys = materialize(keys, "dedup-keys")
    cells, depth = directory(keys, bucket_rows)
    alone = _placed(keys.where("n = 1"), cells, depth).select("bucket", "local_depth", "key", F.lit(None).cast("string").alias("norm"), "text_sha256", "n", "top")
    again = keys.where("n > 1").select("key")
    few = again.count() <= BROADCAST_KEYS
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTIALS)).alias("part")
    met = rows.join(F.broadcast(again), "key") if few else rows
    met = met.groupBy("key", "norm", part).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    met = _placed(met if few else met.join(again, "key"), cells, depth)
    met = met.select("bucket", "local_depth", "key", "norm", F.lit(None).cast("string").alias("text_sha256"), "n", "top")
    owned = materialize(alone.union(met), "dedup-entries").repartitionByRange("bucket", "key")
    line = Window.partitionBy("bucket", "key").orderBy("norm")
    owned = owned.withColumn("fresh", F.when(F.lag("norm").over(line).eqNullSafe(F.col("norm")), 0).otherwise(1))
    owned = owned.withColumn("chain", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    links = owned.groupBy("bucket", "key", "chain").agg(
        F.first("local_depth").alias("local_depth"), F.first("norm").alias("norm"), F.first("text_sha256").alias("sha"), F.max("top").alias("keep_id"), F.sum("n").alias("group_size"),
    )
    links = links.select("bucket", "local_depth", "key", "chain", F.coalesce("sha", F.sha2("norm", 256)).alias("text_sha256"), "keep_id", "group_size")
    return Index(codes, cells, depth, materialize(links, "dedup-index"))


def probe(index: Index) -> DataFrame:
    """One row per indexed row: its key's bucket is found in the directory, and its text's link in that bucket."""
    hit = _placed(index.codes, index.cells, index.depth).drop("local_depth").join(index.entries.drop("local_depth"), ["bucket", "key", "text_sha256"])
    return hit.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts
    the largest doc_id stays. Long texts are compared whole, byte by byte where keys collide. Rows that repeat both doc_id and text are one document given twice
    and share its fate. A null doc_id stays only where its whole group has none. An empty table
    gives an empty result; other columns are ignored. The rows of a common text meet its entry in
    a join that Spark can split when it is skewed.
    """
    return probe(build_index(docs, id_col, text_col, bucket_rows))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows, one.

    Which stay is found by probing the index through its directory; only then do whole rows meet. Nulls and equal texts are treated as in ``exact_dedup``; an empty table stays empty.
    """
    kept = probe(build_index(docs, id_col, text_col)).where("kept").select("doc_id", "text_sha256").distinct().alias("b")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.sha2(_norm(text_col), 256).alias("sha")).alias("a")
    met = rows.join(kept, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.sha") == F.col("b.text_sha256"))).select("a.row", "b.doc_id", "b.text_sha256")
    first = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("text_sha256"))
    return met.withColumn("n", first).where("n = 1").select("row.*")

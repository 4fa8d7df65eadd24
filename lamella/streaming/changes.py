"""Change events as streams: counts, latest states and incremental loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written

CHANGE = "event_type string, entity_type string, entity_id long, parent_id long, at timestamp, payload string"


def read_changes(spark: SparkSession, path: str, schema: str = CHANGE, per_trigger: int = 64) -> DataFrame:
    """Files of change events, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def counts(changes: DataFrame, by: list[Column | str], at: str, late: str = "1 day", every: str | None = None) -> DataFrame:
    """Number of changes per key, or per key and window; state older than ``late`` is dropped for windows."""
    if every is None:
        return changes.groupBy(*by).agg(F.count(F.lit(1)).alias("changes"), F.max(at).alias("last"))
    kept = changes.withWatermark(at, late).groupBy(F.window(at, every).alias("window"), *by)
    return kept.agg(F.count(F.lit(1)).alias("changes")).select(F.col("window.start").alias("start"), *by, "changes")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs all that is available into a memory table and returns it; for reports and tests."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def ingest(stream: DataFrame, path: str, checkpoint: str, by: list[str] | None = None) -> None:
    """Appends what is new to a table; a restart goes on behind the last commit."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (writer.partitionBy(*by) if by else writer).start().awaitTermination()


def dispatch(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, kind: str = "event_type") -> None:
    """Hands each micro-batch's rows of a type to its handler."""

    def each(batch: DataFrame, number: int) -> None:
        for name, handle in handlers.items():
            handle(batch.where(F.col(kind) == name), number)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


ENTITY = "id long, key string, value long, version long, gone boolean, was_key string, was_value long, was_version long, was_gone boolean, batch long, bucket int"
TOTAL = "key string, label string, n long, total long, was_n long, was_total long, batch long, bucket int"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def keep_totals(changes: DataFrame, path: str, checkpoint: str, buckets: int = 16) -> None:
    """Keeps number and sum of entities per key up to date from a stream of changes (id, key, value, version, gone).

    Every micro-batch takes the newest change of each entity, compares it with what is stored, and adds the
    differences to the totals of the keys concerned: of the old key and, where the entity moved, of the new
    one. Only buckets that hold a changed row are rewritten. Changes older than what is stored don't count.
    Stored rows carry their values before their last batch, so a batch that is run again after a failure starts from
    these and gives the same tables. The totals are at ``path``/totals (rows with n > 0 count), the entities at ``path``/entities.
    A key's ``label`` is written with it, as a table that shows both would have it.
    """
    each = lambda batch, number: apply_changes(batch, number, path, buckets)
    changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def apply_changes(batch: DataFrame, number: int, path: str, buckets: int = 16) -> None:
    """Brings one batch of changes into the tables of ``keep_totals``; the same batch and number again change nothing more."""
    spark = batch.sparkSession
    entities, totals = f"{path}/entities", f"{path}/totals"
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")

    def replace(rows: DataFrame, target: str, name: str) -> None:
        written(rows, name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    newest = batch.groupBy("id").agg(F.max_by(F.struct("key", "value", "version", "gone"), "version").alias("c"))
    newest = written(newest.select("id", "c.*", bucket("id").alias("bucket")), "changes")
    touched = F.broadcast(newest.select("bucket").distinct())  # at most ``buckets`` rows
    old = _stored(spark, entities, ENTITY).join(touched, "bucket", "left_semi")
    again = F.col("batch") == number
    before = old.select("id", "bucket", *[F.when(again, F.col(f"was_{c}")).otherwise(F.col(c)).alias(f"was_{c}") for c in ("key", "value", "version", "gone")], *[F.col(c).alias(f"is_{c}") for c in ("key", "value", "version", "gone", "batch")])
    met = before.alias("o").join(newest.alias("n"), ["id", "bucket"], "full")
    wins = F.col("n.version").isNotNull() & (F.col("o.was_version").isNull() | (F.col("n.version") > F.col("o.was_version")))
    now = [F.when(wins, F.col(f"n.{c}")).otherwise(F.col(f"o.was_{c}")).alias(c) for c in ("key", "value", "version", "gone")]
    moved = met.select("id", *now, *[f"o.was_{c}" for c in ("key", "value", "version", "gone")], "o.is_batch", wins.alias("wins"), "bucket")
    same = ["key", "value", "version", "gone"]
    rows = moved.select("id", *same, *[F.col(f"was_{c}") for c in same], F.when(F.col("wins"), F.lit(number)).otherwise(F.coalesce("is_batch", F.lit(number))).cast("long").alias("batch"), "bucket")
    rows = written(rows, "entities")
    part = lambda key, value, gone, sign: F.when(F.col(key).isNotNull() & ~F.coalesce(F.col(gone), F.lit(True)), F.struct(F.col(key).alias("key"), F.lit(sign).alias("n"), (F.col(value) * sign).alias("total")))
    deltas = rows.where(F.col("batch") == number).select(F.explode(F.array_compact(F.array(part("was_key", "was_value", "was_gone", -1), part("key", "value", "gone", 1)))).alias("d")).select("d.*")
    deltas = written(deltas.groupBy("key").agg(F.sum("n").alias("dn"), F.sum("total").alias("dt")).withColumn("bucket", bucket("key")), "deltas")
    concerned = F.broadcast(deltas.select("bucket").distinct())
    held = _stored(spark, totals, TOTAL).join(concerned, "bucket", "left_semi")
    base = held.select("key", "bucket", *[F.when(again, F.col(f"was_{c}")).otherwise(F.col(c)).alias(f"was_{c}") for c in ("n", "total")], *[c for c in ("n", "total", "batch")])
    both = base.join(deltas, ["key", "bucket"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    hit = F.col("dn").isNotNull()
    out = both.select(
        "key", F.concat(F.lit("key "), "key").alias("label"), F.when(hit, zero("was_n") + zero("dn")).otherwise(zero("n")).alias("n"), F.when(hit, zero("was_total") + zero("dt")).otherwise(zero("total")).alias("total"),
        zero("was_n").alias("was_n"), zero("was_total").alias("was_total"), F.when(hit, F.lit(number)).otherwise(F.col("batch")).cast("long").alias("batch"), "bucket",
    )
    replace(rows, entities, "entities-next")
    replace(out, totals, "totals-next")


def append_history(rows: DataFrame, path: str, at: str) -> None:
    """Appends metric or alert rows to a history, by day."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)

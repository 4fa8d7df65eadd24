"""Nested documents, landing zone and keyed writes."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

RESULT = "struct<name:string,team:string,rank:int,scores:array<string>>"
SIDE = "struct<name:string,team:string,seed:int,score:int>"
FLAT_SIDES = ",".join(f"player{i}_seed:int,player{i}_name:string,player{i}_team:string,player{i}_score:int" for i in (1, 2))
ENTRY = "struct<round:string,table_index:int,seed:int,name:string,team:string,is_match_result:boolean,score:string>"
EVENT = (
    "struct<event_cd:string,sub_event_cd:string,name:string,weapon:string,gender:string,event_type:string,age_group:string,total_participants:int,"
    f"pool_rounds:array<struct<round_number:int,pool_number:int,results:array<{RESULT}>>>,final_rankings:array<struct<rank:int,name:string,team:string>>,"
    f"seeding:array<struct<seed:int,name:string,team:string>>,de_matches:array<{ENTRY}>,results_by_round:map<string,array<{ENTRY}>>,"
    f"bouts_by_round:map<string,array<struct<player1:{SIDE},player2:{SIDE},winnerName:string,isBye:boolean,{FLAT_SIDES},winner_name:string,is_bye:boolean>>>,"
    f"full_bouts:array<struct<round:string,table_index:int,winner:{SIDE},loser:{SIDE},score:struct<winner_score:int,loser_score:int>>>,"
    f"bouts:array<struct<round:string,match_number:int,player1:{SIDE},player2:{SIDE},winner_name:string,is_bye:boolean>>>"
)
DOCUMENT = f"competition struct<event_cd:string,name:string,start_date:string,end_date:string,status:string,location:string>, events array<{EVENT}>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Competition documents from JSON files, with an explicit schema."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def land(raw: DataFrame, path: str, url: str, content: str, at: Column) -> None:
    """Appends raw content to the landing zone, by date."""
    out = raw.select(F.col(url).alias("source_url"), F.col(content).alias("content"), F.length(content).alias("content_length"), F.sha2(F.col(content), 256).alias("scrape_id"), at.cast("date").alias("date"))
    out.write.mode("append").partitionBy("date").parquet(path)


def read_landed(spark: SparkSession, path: str, scrape_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("scrape_id") == scrape_id)


def merged(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert by key: of old and new rows the highest version stays, the new one on a tie."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__new")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by key where the new rows have each key once: old rows without a new one, and the new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def with_actions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, each marked created or updated."""
    known = old.select(*keys).distinct().withColumn("__known", F.lit(True))
    return new.join(known, keys, "left").withColumn("action", F.when(F.col("__known"), "updated").otherwise("created")).drop("__known")


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Delete and insert by partition: only the partitions of ``rows`` are rewritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def save_validated(checked: DataFrame, good: str, quarantine: str) -> None:
    """Rows that can be saved go to ``good``, the others with their errors to ``quarantine``."""
    checked.where("can_save").drop("errors", "can_save").write.mode("append").parquet(good)
    checked.where("not can_save").write.mode("append").parquet(quarantine)


def save_counted(checked: DataFrame, path: str, counters: dict[str, Column] | None = None) -> dict[str, int]:
    """Saves rows by status below ``path`` (``status=saved`` and ``status=quarantined``) and returns the counters of that same job.

    Counted with ``observe`` while the rows are written: all rows, saved ones, quarantined ones, and what ``counters`` names
    (aggregates). The table isn't read a second time, neither for counting nor for the second folder.
    """
    good = F.coalesce(F.col("can_save"), F.lit(False))
    metrics = {"total": F.count(F.lit(1)), "saved": F.count_if(good), "quarantined": F.count_if(~good), **(counters or {})}
    seen = Observation()
    rows = checked.observe(seen, *[c.alias(name) for name, c in metrics.items()])
    rows.withColumn("status", F.when(good, "saved").otherwise("quarantined")).write.mode("append").partitionBy("status").parquet(path)
    return seen.get


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; only a local master may go without spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lamella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder: lineage ends there, and a lost executor costs nothing before it."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/lamella-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def tasks_for(rows: DataFrame, each: int = 200_000) -> int:
    """How many tasks of about ``each`` rows ``rows`` fill, at least one a core. Counted when this is called; of a Parquet table that reads the footers only."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def spread(rows: DataFrame, *by: str, each: int = 200_000) -> DataFrame:
    """``rows`` dealt out by ``by`` over all cores, in tasks of about ``each`` rows (see ``tasks_for``): a larger table gets more of them, no larger ones."""
    return rows.repartition(tasks_for(rows, each), *by)


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``rows`` and ``name``: their number, from 1, among the rows of equal ``by`` (nulls are equal) in ``order``.

    Rows are dealt out in ranges of both, counted inside a range, and each range adds the counts
    of those before it, so no task sorts a whole group, however large. The ranges are written when
    this is called, as they must not change when a task is run again. Rows that tie in all of
    ``order`` get their numbers in any order.
    """
    ranged = written(rows.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    counted = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__p", *by).orderBy(*order)))
    sizes = ranged.groupBy("__p", *by).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = sizes.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__by_{c}") for c in by], F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    same = [F.col("__p") == F.col("__q"), *[F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]]
    return counted.join(sizes, reduce(Column.__and__, same)).select(*rows.columns, (F.col("__n") + F.col("__before")).alias(name))


def with_surrogate_ids(rows: DataFrame, keys: list[str], known: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """keys, id: known ids stay; new keys get the next ones in key order.

    New keys are numbered in ranges (see ``numbered``), so no single task sorts all of them.
    """
    fresh = rows.select(*keys).distinct()
    top = 0
    if known is not None:
        fresh = fresh.join(known.select(*keys), keys, "left_anti")
        top = known.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    new = numbered(fresh, [], keys, id_col).select(*keys, (F.col(id_col) + top).alias(id_col))
    return new if known is None else known.select(*keys, id_col).unionByName(new)


def purge(rows: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last ``days``."""
    return rows.where(F.col(at) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))

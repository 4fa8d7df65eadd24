"""Paced and paged loads, page streams, kept totals, counted saves, look-backs and JSON trees over the benchmark tables, with their SQL."""

from __future__ import annotations

import json
import os

import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json_trees as J
from ..operators import quality as Q
from ..sources import pages as P
from ..sources import tables as T
from ..streaming import changes as C
from .registry import query


def _order_pages(t) -> DataFrame:
    """page, body: pages of 200 keys of the orders, as a server would answer."""
    row = F.struct("o_orderkey", "o_custkey", "o_totalprice")
    return t("orders").groupBy(F.floor(F.col("o_orderkey") / 200).cast("long").alias("page")).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("body"))  # 200 keys


def _answer(request: dict, attempt: int) -> str:
    """A server that fails at every eleventh page but one for good, and at every third for the first time."""
    page = request["page"]
    if page % 11 == 5:
        raise TimeoutError(f"page {page}")
    if page % 3 == 0 and attempt == 1:
        raise ConnectionError("try again")
    return request["body"]


def _fetched(t) -> DataFrame:
    return P.fetch_pages(_order_pages(t), "page", _answer, lanes=3, delay=0.0, attempts=3, pause=0.001)


@query("""
    SELECT c_custkey, c_name, count(o_orderkey) AS orders, coalesce(min(o_orderkey), -1) AS first_order FROM customer LEFT JOIN (SELECT * FROM orders WHERE (o_orderkey // 200) % 11 <> 5) ON o_custkey = c_custkey GROUP BY 1, 2""")
def paged_load(t):
    """Good pages of a server that fails by plan, regrouped under the customers."""
    rows = P.answered(_fetched(t), "o_orderkey long, o_custkey long, o_totalprice double")
    nested = P.regrouped(t("customer").select("c_custkey", "c_name"), rows.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "orders")
    return nested.select("c_custkey", "c_name", F.size("orders").cast("long").alias("orders"), F.coalesce(F.get("orders", F.lit(0))["o_orderkey"], F.lit(-1)).alias("first_order"))


@query("""
    SELECT DISTINCT o_orderkey // 200 AS page, 3 AS attempts, 'TimeoutError: page ' || o_orderkey // 200 AS error FROM orders WHERE (o_orderkey // 200) % 11 = 5""")
def failed_pages(t):
    return P.failed(_fetched(t), "page")


def _stored_page(page: int, options: dict) -> list[tuple]:
    """The rows of a page that lies as JSON lines in a folder of its own."""
    files, root = pyarrow.fs.FileSystem.from_uri(options["path"])
    found = []
    for info in files.get_file_info(pyarrow.fs.FileSelector(f"{root}/page={page}", allow_not_found=True)):
        if info.base_name.startswith("part-"):
            with files.open_input_stream(info.path) as f:
                found += [(page, row["event_id"], row["event_type"]) for row in map(json.loads, f.read().splitlines())]
    return found


@query("""
    SELECT event_id // 500 + 1 AS page, count(*) AS events, count(DISTINCT event_id) AS different, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1""")
def paged_stream_runs(t):
    """Two runs of a page stream over a growing table, the second from the last commit: each page once."""
    events = t("events")
    spark = events.sparkSession
    root = f"{T.shared_folder(spark)}/lamella-{spark.sparkContext.applicationId}/pages-{os.urandom(6).hex()}"
    page = (F.floor(F.col("event_id") / 500) + 1).cast("long")
    events.select("event_id", "event_type", page.alias("page")).write.partitionBy("page").json(f"{root}/in")
    pages = events.agg(F.max(page)).first()[0] or 0
    spark.dataSource.register(P.paged_stream("stored_pages", "page long, event_id long, event_type string", _stored_page))
    uri = root if "://" in root or root.startswith("file:") else f"file://{root}"
    for newest in (pages // 2, pages, pages):
        stream = spark.readStream.format("stored_pages").option("newest", newest).option("path", f"{uri}/in").load()
        C.ingest(stream, f"{root}/out", f"{root}/state")
    got = spark.read.schema("page long, event_id long, event_type string").parquet(f"{root}/out")
    return got.groupBy("page").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("different"), F.count_if(F.col("event_type") == "error").alias("errors"))


def _entity_changes(t) -> DataFrame:
    """Events as changes of 997 entities, which move between users and go with an error."""
    return t("events").select((F.col("event_id") % 997).alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.bround(F.col("value") * 100).cast("long").alias("value"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("gone"))


@query("""
    WITH l AS (SELECT event_id % 997 AS id, arg_max('u' || user_id, event_id) AS key, CAST(arg_max(round_even(value * 100, 0), event_id) AS BIGINT) AS value, arg_max(event_type, event_id) = 'error' AS gone FROM events GROUP BY 1)
    SELECT key, 'key ' || key AS label, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM l WHERE NOT gone GROUP BY 1""")
def kept_totals(t):
    """Totals per user after three batches of inserts, updates, moves and deletes, the middle one out of order and the last repeated."""
    changes = _entity_changes(t)
    spark = changes.sparkSession
    root = f"{T.shared_folder(spark)}/lamella-{spark.sparkContext.applicationId}/totals-{os.urandom(6).hex()}"
    third = F.pmod(F.floor(F.col("version") / 1000), F.lit(3))
    for part in (2, 0, 1, 1):
        changes.where(third == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = C.read_changes(spark, f"{root}/in", "id long, key string, value long, version long, gone boolean")
        C.keep_totals(stream, f"{root}/kept", f"{root}/state")
    return spark.read.schema(C.TOTAL).parquet(f"{root}/kept/totals").where("n > 0").select("key", "label", "n", "total")


@query("""
    SELECT count(*) AS total, count(*) FILTER (l_quantity <= 45 AND l_discount >= 0) AS saved, count(*) FILTER (l_quantity > 45) AS quarantined, count(*) FILTER (l_quantity > 45 AND l_tax > 0.04) AS taxed, count(*) FILTER (l_quantity > 45) AS stored_errors FROM lineitem""")
def counted_save(t):
    """Counters of a save taken in the job that writes it, beside what the quarantine holds."""
    rows = t("lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", ((F.col("l_quantity") <= 45) & (F.col("l_discount") >= 0)).alias("can_save"))
    spark = rows.sparkSession
    root = f"{T.shared_folder(spark)}/lamella-{spark.sparkContext.applicationId}/counted-{os.urandom(6).hex()}"
    got = T.save_counted(rows, root, {"taxed": F.count_if((F.col("l_quantity") > 45) & (F.col("l_tax") > 0.04))})
    held = spark.read.parquet(f"{root}/status=quarantined").agg(F.count(F.lit(1)).alias("stored_errors"))
    return held.select(*[F.lit(got[n]).cast("long").alias(n) for n in ("total", "saved", "quarantined", "taxed")], "stored_errors")


AS_OF = "2024-01-15 12:00:00"


@query(f"""
    SELECT event_type, arg_max(value, (ts, event_id)) AS latest, max(ts) AS latest_at, count(*) FILTER (ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR) AS last_1h, count(*) FILTER (ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS last_24h
    FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY 1""")
def metric_look_back(t):
    return Q.look_back(t("events"), "event_type", "value", "ts", AS_OF, tie=("event_id",))


@query(f"""
    WITH l AS (SELECT event_type, arg_max(value, (ts, event_id)) AS latest FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY 1)
    SELECT event_type, latest, CASE event_type WHEN 'click' THEN 1000.0 ELSE 0.5 END AS threshold, TIMESTAMP '{AS_OF}' AS at, DATE '2024-01-15' AS day FROM l WHERE (event_type = 'click' AND latest < 1000) OR (event_type IN ('error', 'view') AND latest > 0.5)""")
def alert_history(t):
    """Metrics beyond their limits, appended to a history and read back."""
    latest = Q.look_back(t("events"), "event_type", "value", "ts", AS_OF, tie=("event_id",))
    spark = latest.sparkSession
    root = f"{T.shared_folder(spark)}/lamella-{spark.sparkContext.applicationId}/alerts-{os.urandom(6).hex()}"
    C.append_history(Q.alerts(latest, "event_type", {"click": (1000.0, True), "error": (0.5, False), "view": (0.5, False)}, AS_OF), root, "at")
    return spark.read.schema("event_type string, latest double, threshold double, at timestamp, day date").parquet(root)


@query("""
    SELECT event_id, replace(props, '"k"', '"key"') AS flat, '{"a": {"k": [1, {"b": ' || replace(props, '"k"', '"a"') || '}]}, "note": "say \\"k\\": no", "k2": 1, "k": "a"}' AS deep, 7 AS keys FROM events""")
def renamed_json(t):
    """Keys of props, and two names exchanged at every depth of larger documents; values that look like keys stay."""
    deep = F.concat(F.lit('{"k": {"a": [1, {"b": '), "props", F.lit('}]}, "note": "say \\"k\\": no", "k2": 1, "a": "a"}'))
    return t("events").select("event_id", J.renamed_keys("props", {"k": "key"}).alias("flat"), J.renamed_keys(deep, {"k": "a", "a": "k"}).alias("deep"), F.size(J.every_key(deep)).alias("keys"))


@query("""
    SELECT l_orderkey, l_returnflag AS flag, count(*) AS lines, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS numbers FROM lineitem GROUP BY 1, 2""")
def nested_by_round(t):
    """The lines of each order as one list, grouped by their flag without leaving the row."""
    lines = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"))).alias("lines"))  # the lines of an order
    rows = lines.select("l_orderkey", F.explode(J.grouped("lines", "l_returnflag")).alias("flag", "some"))
    return rows.select("l_orderkey", "flag", F.size("some").cast("long").alias("lines"), F.col("some.l_linenumber").alias("numbers"))

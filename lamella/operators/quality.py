"""Validation rules, quality metrics and club reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKING = ("CRITICAL", "HIGH")


@dataclass(frozen=True)
class Rule:
    field: str
    severity: str
    message: str
    broken: Column


def validate(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``errors`` (field, severity, message of each broken rule) and ``can_save``.

    A rule that gives null isn't broken. A row can be saved without critical or high errors.
    """
    each = [F.when(r.broken, F.struct(F.lit(r.field).alias("field"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))) for r in rules]
    checked = rows.withColumn("errors", F.array_compact(F.array(*each)))
    return checked.withColumn("can_save", ~F.exists("errors", lambda e: e["severity"].isin(*BLOCKING)))


def two_stage(rows: DataFrame, technical: list[Rule], business: list[Rule]) -> DataFrame:
    """Business rules are checked where the technical ones let a row pass."""
    first = validate(rows, technical).withColumnsRenamed({"errors": "__t", "can_save": "__ok"})
    second = validate(first, business)
    later = F.when(F.col("__ok"), F.col("errors")).otherwise(F.array().cast(second.schema["errors"].dataType))
    return second.withColumn("errors", F.concat("__t", later)).withColumn("can_save", F.col("__ok") & F.col("can_save")).drop("__t", "__ok")


def player_rules(year: int) -> list[Rule]:
    name = F.col("name")
    return [
        Rule("name", "CRITICAL", "length", F.coalesce(~F.length(name).between(2, 50), F.lit(True))),
        Rule("birth_year", "HIGH", "range", ~F.col("birth_year").between(1940, 2020)),
        Rule("birth_year", "HIGH", "too young", F.col("birth_year") > year - 5),
        Rule("name", "WARNING", "digits", name.rlike("[0-9]")),
        Rule("name", "WARNING", "long", F.length(name) > 10),
    ]


def match_rules() -> list[Rule]:
    a, b = F.col("player1_score"), F.col("player2_score")
    return [
        Rule("score", "CRITICAL", "range", ~a.between(0, 45) | ~b.between(0, 45)),
        Rule("player", "CRITICAL", "same player", F.col("player1") == F.col("player2")),
        Rule("score", "WARNING", "tie", (a == b) & (a > 0)),
        Rule("score", "WARNING", "high", F.greatest(a, b) > 15),
    ]


def event_rules() -> list[Rule]:
    """Rules of an event with event_name, weapon and gender (as found in the name) and participants."""
    named = F.coalesce(F.length("event_name") > 0, F.lit(False))
    return [
        Rule("event_name", "CRITICAL", "missing", ~named),
        Rule("participants", "CRITICAL", "negative", F.col("participants") < 0),
        Rule("event_name", "MEDIUM", "weapon not named", named & F.col("weapon").isNull()),
        Rule("event_name", "MEDIUM", "gender not named", named & F.col("gender").isNull()),
    ]


def competition_rules() -> list[Rule]:
    return [
        Rule("comp_idx", "CRITICAL", "missing", F.coalesce(F.length("comp_idx") < 1, F.lit(True))),
        Rule("comp_name", "CRITICAL", "missing", F.coalesce(F.length("comp_name") < 1, F.lit(True))),
        Rule("end_date", "CRITICAL", "ends before its start", F.col("end_date") < F.col("start_date")),
    ]


def competition_status(start: Column | str, end: Column | str, as_of: str, otherwise: Column | str) -> Column:
    """Status by the dates: over, running (an open end runs on), or planned; without a start it stays."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    day = F.lit(as_of).cast("date")
    found = F.when(end < day, F.lit("종료")).when(start <= day, F.lit("진행중")).when(start > day, F.lit("예정"))
    return F.coalesce(F.when(start.isNotNull(), found), F.col(otherwise) if isinstance(otherwise, str) else otherwise)


def inconsistent(rows: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, old, new of known rows whose set fields differ from the stored ones; new keys have none."""
    old = stored.select(F.col(key), *[F.col(f).alias(f"__{f}") for f in fields])
    each = [F.struct(F.lit(f).alias("field"), F.col(f"__{f}").cast("string").alias("old"), F.col(f).cast("string").alias("new")) for f in fields]
    found = rows.join(old, key).select(key, F.explode(F.array(*each)).alias("d")).select(key, "d.*")
    return found.where("old <> new and old <> '' and new <> ''")


def repeated(rows: DataFrame, keys: list[str], name: str = "times") -> DataFrame:
    """keys, times of the keys that several rows share."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def guardian_missing(rows: DataFrame, born: str, guardian: str, as_of: str, age: int = 14) -> DataFrame:
    """Rows of members under ``age`` on the day without a guardian."""
    young = F.col(born) > F.add_months(F.lit(as_of).cast("date"), -12 * age)
    return rows.where(young & F.col(guardian).isNull())


def latency_ms(start: Column | str, end: Column | str) -> Column:
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def acknowledged(alerts: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """Alerts with ``acknowledged`` set for the keys of ``done``."""
    marks = done.select(key).distinct().withColumn("__done", F.lit(True))
    return alerts.join(marks, key, "left").withColumn("acknowledged", F.coalesce("__done", F.lit(False))).drop("__done")


def ranking_rules() -> list[Rule]:
    return [
        Rule("rank", "CRITICAL", "range", F.coalesce(~F.col("rank").between(1, 256), F.lit(True))),
        Rule("wins", "WARNING", "first without wins", (F.col("rank") == 1) & (F.col("wins") == 0)),
    ]


def metric(name: str, value: Column, threshold: float, at_least: bool) -> Column:
    """A metric with its threshold: healthy or not, and severity by relative deviation."""
    gap = F.abs(value - threshold) / threshold
    healthy = value >= threshold if at_least else value <= threshold
    severity = F.when(healthy, "ok").when(gap > 0.5, "critical").when(gap > 0.2, "error").when(gap > 0.1, "warning").otherwise("info")
    return F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), F.lit(threshold).alias("threshold"), healthy.alias("healthy"), severity.alias("severity"))


def look_back(rows: DataFrame, name: str, value: str, at: str, as_of: str, hours: tuple[int, ...] = (1, 24), tie: tuple[str, ...] = ()) -> DataFrame:
    """name, latest, latest_at and the number of values in the last ``hours`` before ``as_of``, per metric; one aggregation.

    Later rows don't count; rows of the same time are ordered by ``tie``, then value. A row exactly so many hours old isn't in the look-back.
    """
    now = F.lit(as_of).cast("timestamp")
    seen = rows.where(F.col(at) <= now)
    counts = [F.count_if(F.col(at) > now - F.make_dt_interval(F.lit(0), F.lit(h))).alias(f"last_{h}h") for h in hours]
    return seen.groupBy(name).agg(F.max_by(value, F.struct(at, *tie, value)).alias("latest"), F.max(at).alias("latest_at"), *counts)


def alerts(latest: DataFrame, name: str, limits: dict[str, tuple[float, bool]], as_of: str) -> DataFrame:
    """name, latest, threshold, at of the metrics beyond their limit (threshold, whether it is a least value), as rows for a history."""
    limit = lambda part: F.coalesce(*[F.when(F.col(name) == m, F.lit(v[part])) for m, v in limits.items()])
    rows = latest.withColumns({"threshold": limit(0), "least": limit(1)})
    broken = F.when(F.col("least"), F.col("latest") < F.col("threshold")).otherwise(F.col("latest") > F.col("threshold"))
    return rows.where(broken).select(name, "latest", "threshold", F.lit(as_of).cast("timestamp").alias("at"))


def duplicate_rate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, duplicates, rate: rows beyond the first of their key."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return out.withColumn("rate", F.coalesce(F.bround(F.try_divide("duplicates", "rows"), 6), F.lit(0.0)))


def health(metrics: DataFrame) -> DataFrame:
    """Share of healthy metrics and its grade."""
    out = metrics.agg(F.avg(F.col("healthy").cast("int")).alias("share"))
    return out.withColumn("health", F.when(F.col("share") >= 0.9, "healthy").when(F.col("share") >= 0.7, "degraded").otherwise("unhealthy"))


def attendance(rows: DataFrame, by: list[str], ts: str, kinds: dict[str, Column]) -> DataFrame:
    """Distinct days, events and counts by kind, per key and month."""
    month = F.date_format(ts, "yyyy-MM")
    return rows.groupBy(*by, month.alias("month")).agg(F.countDistinct(F.to_date(ts)).alias("days"), F.count(F.lit(1)).alias("entries"), *[F.count_if(c).alias(k) for k, c in kinds.items()])


def fee_summary(rows: DataFrame, by: list[str], amount: str, status: str, groups: dict[str, list[str]]) -> DataFrame:
    """Sums by group of statuses, the count, and the share collected under the first group."""
    money = F.col(amount).cast("decimal(18,2)")
    sums = {k: F.coalesce(F.sum(F.when(F.col(status).isin(*v), money)), F.lit(0)).cast("double") for k, v in groups.items()}
    first = next(iter(groups))
    out = rows.groupBy(*by).agg(*[F.bround(c, 2).alias(k) for k, c in sums.items()], F.bround(F.sum(money).cast("double"), 2).alias("billed"), F.count(F.lit(1)).alias("fees"))
    return out.withColumn("collected_rate", F.bround(F.try_divide(F.col(first) * 100, F.col("billed")), 1))


def overdue(rows: DataFrame, due: str, as_of: str, open_rows: Column) -> DataFrame:
    days = F.datediff(F.lit(as_of).cast("date"), F.to_date(due))
    return rows.where(open_rows & (days > 0)).withColumn("overdue_days", days)


def mean_of_means(rows: DataFrame, outer: list[str], inner: str, value: Column) -> DataFrame:
    """The average of each member's rate, not the pooled one."""
    each = rows.groupBy(*outer, inner).agg(F.avg(value.cast("double")).alias("__r"), F.count(F.lit(1)).alias("__n"))
    return each.groupBy(*outer).agg(F.count(F.lit(1)).alias("members"), F.sum("__n").alias("rows"), F.bround(F.avg(F.bround("__r", 6)), 4).alias("mean_rate"))

"""Addresses of organisations: looked up source by source, and reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def look_up(teams: DataFrame, key: str, sources: list[tuple[str, DataFrame]], known: str = "address") -> DataFrame:
    """Adds ``found``, ``source`` and ``status`` to every team.

    A team whose ``known`` address is given is skipped; others take the address of the first
    source, in order, that has their key (``collected``), or none (``failed``). A source has
    columns key and address; of several addresses of one key the least counts. Null keys are
    found nowhere; empty addresses count as absent. Each source is one equi join on its own
    distinct keys, which Spark broadcasts when it is small.
    """
    out, hits = teams, []
    for name, table in sources:
        place = F.nullif(F.trim("address"), F.lit(""))
        one = table.select(F.col("key").alias(f"__{name}_key"), place.alias("a")).groupBy(f"__{name}_key").agg(F.min("a").alias(f"__{name}"))
        out = out.join(one, F.col(key) == F.col(f"__{name}_key"), "left")
        hits.append((name, F.col(f"__{name}")))
    has = F.nullif(F.trim(known), F.lit(""))
    first = F.coalesce(F.lit(None).cast("string"), *[c for _, c in hits])
    source = F.coalesce(F.lit(None).cast("string"), *[F.when(c.isNotNull(), F.lit(name)) for name, c in hits])
    status = F.when(has.isNotNull(), "skipped").when(first.isNotNull(), "collected").otherwise("failed")
    return out.select(*teams.columns, F.coalesce(has, first).alias("found"), F.when(has.isNull(), source).alias("source"), status.alias("status"))


def report(looked_up: DataFrame, kind: str) -> DataFrame:
    """Per kind of organisation: total, collected, failed, skipped and the share collected in per cent."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    counted = looked_up.groupBy(kind).agg(F.count(F.lit(1)).alias("total"), of("collected"), of("failed"), of("skipped"))
    return counted.withColumn("success_rate", F.bround(F.col("collected") * 100 / F.col("total"), 1))


def full_school_name(name: Column | str) -> Column:
    """A school's registered name from its short form: the endings of schools spelt out, signs left out."""
    c = F.col(name) if isinstance(name, str) else name
    for short, whole in SCHOOL_ENDINGS.items():
        c = F.regexp_replace(c, f"{short}$", whole)
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]", "")


#: Short endings of Korean schools and what they stand for.
SCHOOL_ENDINGS = {"중": "중학교", "고": "고등학교", "초": "초등학교", "대": "대학교"}

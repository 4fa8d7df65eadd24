"""Mixing sources to target weights by Sainte-Laguë apportionment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.sources.tables import numbered

from .common import materialize

SPACE = " \t\n\x0b\x0c\r"
#: Rows up to which a table of sources and shards is broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: 0), with no list of them in memory."""
    plain = F.trim(F.translate(text, SPACE, " " * len(SPACE)))
    return F.coalesce(F.length(F.regexp_replace(plain, "[^ ]+ *", "x")), F.lit(0)).cast("long")


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def _with_sums(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with sums over each group of ``by`` (over all rows, if it is empty)."""
    found = rows.groupBy(*by).agg(*[c.alias(name) for name, c in sums.items()])
    if not by:
        one = found.first()  # one row
        return rows.select("*", *[F.lit(one[name]).alias(name) for name in sums])
    return rows.alias("a").join(found.alias("b"), _same("a", "b", by)).select("a.*", *[f"b.{name}" for name in sums])


def sainte_lague(parties: DataFrame, by: list[str], order: str, votes: str, seats: str) -> DataFrame:
    """``parties`` and ``quota``: ``seats`` (one number per group of ``by``) dealt to the highest quotients votes / (2k - 1).

    Ties go to the least ``order``, a number that tells the parties of a group apart; a party without votes gets nothing, nor
    does a group without any. The quotients aren't listed one by one: rounding votes / (all votes
    / seats) is right but for at most half a seat per party, and only the quotients about that
    point, at most four a party, are ranked (in ranges, so a large group is no single task).
    """
    by_, keys = [f"g{i}" for i in range(len(by))], [F.col(c).alias(f"g{i}") for i, c in enumerate(by)]
    met = parties.select(*keys, F.col(order).alias("o"), F.col(votes).alias("v"), F.col(seats).alias("s"), F.struct(*parties.columns).alias("row"))
    met = _with_sums(met, by_, {"all": F.sum("v").cast("double"), "n": F.count(F.lit(1))})
    share = F.when(F.col("v") > 0, F.col("v") / F.col("all")).otherwise(0.0)
    met = met.withColumn("share", share).withColumn("near", F.floor(F.col("share") * F.col("s") + 0.5))
    met = _with_sums(met, by_, {"got": F.sum("near")}).withColumn("over", F.col("got") - F.col("s"))
    met = materialize(met, "mix-near")
    reach, gain = F.ceil(F.col("share") * (F.abs("over") + F.col("n"))) + 1, F.col("over") < 0
    first = F.when(gain, F.col("near") + 1).otherwise(F.greatest(F.lit(1), F.col("near") - reach + 1))
    last = F.when(gain, F.col("near") + reach).otherwise(F.col("near"))
    open_ = met.where((F.col("v") > 0) & (F.col("over") != 0) & (last >= first)).withColumn("k", F.explode(F.sequence(first, last)))
    quotient = F.col("v") / (2 * F.col("k") - 1)
    keyed = open_.select(*by_, "o", "over", F.when(gain, -quotient).otherwise(quotient).alias("first"), F.when(gain, F.col("o")).otherwise(-F.col("o")).alias("then"))
    moved = numbered(keyed, by_, ["first", "then"], "nth").where(F.col("nth") <= F.abs("over")).groupBy(*by_, "o").agg(F.count(F.lit(1)).alias("moved"))
    joined = met.alias("a").join(_bounded(materialize(moved, "mix-moved")).alias("b"), _same("a", "b", [*by_, "o"]), "left")
    change = F.coalesce(F.col("b.moved"), F.lit(0)) * F.when(F.col("a.over") < 0, 1).otherwise(-1)
    return joined.select("a.row.*", (F.col("a.near") + change).cast("long").alias("quota"))


def targets(sources: DataFrame, limit: int) -> DataFrame:
    """``sources`` (source_size, weight) and ``target``, ``full``: shares of all sizes by weight, ``limit`` sizes of the source at most.

    What a limit cuts off is shared out anew by weight. The level (words per unit of weight) rises
    round by round as more sources are full; these are Newton's steps on a concave line of straight
    pieces, so few rounds are needed, each one sum over the table of sources.
    """
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    cap, free_words, free_weight, known = F.col("source_size") * limit, total or 0, weights or 0, -1
    full = F.lit(False)
    while free_weight:
        full = F.col("weight") * F.lit(float(free_words)) / free_weight >= cap
        held = sources.where(full).agg(F.count(F.lit(1)), F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if held[0] == known:
            break
        known, free_words, free_weight = held[0], (total or 0) - held[1], weights - held[2]
    if not free_weight:
        full = F.lit(True)
    share = F.col("weight") * F.lit(float(free_words)) / F.lit(float(free_weight or 1))
    return sources.withColumn("full", full).withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(share))


def mixture(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, shards: int = 16, block: int = 32, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, shard, copies, start, upto, wrapped for every row of ``docs``.

    Size is the number of words. Sources in code-point order, null last, weigh ``weights``, over
    and over; together they share as many words as there are, none more than ``limit`` times its
    own (see ``targets``). Words come in blocks of ``block``: Sainte-Laguë deals all blocks to the
    sources and then each source's blocks to its shards, in proportion to what they hold. A shard
    is a run of the source's documents in the order of a seeded hash. Its quota of blocks is chosen
    from a block that the seed draws, onwards and around, as often as the quota asks. A document is so
    taken ``copies`` times whole and from its words ``start`` to ``upto`` once more, and where the
    run ends in the document where it began, its first ``wrapped`` words as well. A source at its
    limit gives all its blocks ``limit`` times.

    A source's words differ from its target by about one block, and by ``limit`` times its words at
    most. A document is never taken more than ``limit`` times. The same rows give the same result,
    whatever their partitions; rows that agree in id, size and source are told apart by nothing,
    so each of them has some row's share. Null texts have no words, a null source is a source,
    null ids are allowed; long texts are counted whole; other columns are ignored; an empty table
    gives an empty result. Positions are counted in ranges (tables in the shared folder, written
    when this is called), so that no task orders a whole source.
    """
    size = word_count(F.col(text_col))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    sized = materialize(sized.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 1)), "mix-sizes")
    shard = F.expr(f"cast(shiftright(shiftright(h, 31) * {shards}, 32) as int)")
    order = ["h", "doc_id", "size"]
    ranged = sized.withColumn("shard", shard).repartitionByRange("source", *order).withColumn("p", F.spark_partition_id())
    ranged = materialize(ranged, "mix-lines")
    parts = ranged.groupBy("p", "source", "shard").agg(F.sum("size").alias("w"))
    before = Window.partitionBy("source", "shard").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parts = parts.select("p", "source", "shard", "w", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("before"))
    parts = materialize(parts, "mix-parts")

    lines = parts.groupBy("source", "shard").agg(F.sum("w").alias("line"))
    found = parts.groupBy("source").agg(F.sum("w").alias("source_size"))
    placed = numbered(found.withColumn("last", F.col("source").isNull()), [], ["last", "source"], "place").drop("last")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    goals = materialize(targets(materialize(placed.withColumn("weight", weight), "mix-sources"), limit), "mix-targets")
    free = goals.where("not full")
    seats = int((free.agg(F.sum("target")).first()[0] or 0.0) / block + 0.5)
    dealt = sainte_lague(free.withColumn("seats", F.lit(seats).cast("long")), [], "place", "weight", "seats").select("place", F.col("quota").alias("blocks"))
    goals = goals.alias("a").join(_bounded(materialize(dealt, "mix-blocks")).alias("b"), F.col("a.place") == F.col("b.place"), "left").select("a.*", F.coalesce("b.blocks", F.lit(0)).alias("blocks"))
    goals = materialize(goals, "mix-goals")
    held = lines.alias("a").join(_bounded(goals).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.source_size", "b.place", "b.target", "b.full", "b.blocks")
    quotas = sainte_lague(materialize(held, "mix-shards"), ["place"], "shard", "line", "blocks")
    words = F.when(F.col("full"), F.col("line") * limit).otherwise(F.least(F.col("quota") * block, F.col("line") * limit))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "place", "shard"), F.greatest(F.lit(1), F.ceil(F.col("line") / block))) * block
    plan = materialize(quotas.withColumn("words", words).withColumn("from", drawn), "mix-plan")

    inside = Window.partitionBy("p", "source", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("here", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.alias("a").join(_bounded(parts).alias("b"), _same("a", "b", ["p", "source", "shard"])).select("a.*", (F.col("a.here") + F.col("b.before")).alias("at"))
    rows = rows.alias("a").join(_bounded(plan).alias("b"), _same("a", "b", ["source", "shard"])).select("a.*", "b.source_size", "b.target", "b.line", "b.words", "b.from")
    rows = rows.withColumn("copies", F.expr("if(line > 0, words div line, 0)")).withColumn("rest", F.expr("if(line > 0, words % line, 0)"))
    # the run of the rest is [from, end) on the line, and [0, end - line) where it goes around
    rows = rows.withColumn("end", F.col("from") + F.col("rest"))

    def clip(word: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), word - F.col("at")))

    rows = rows.withColumn("start", clip(F.col("from"))).withColumn("upto", clip(F.col("end"))).withColumn("wrapped", clip(F.col("end") - F.col("line")))
    taken = F.col("copies") * F.col("size") + F.col("upto") - F.col("start") + F.col("wrapped")
    kept = ["source", "shard", "copies", "start", "upto", "wrapped"]
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *kept)


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how: object) -> DataFrame:
    """shard, doc_id, source, nth, text: the pieces of the mix, whole copies first, then the words that a run cuts out.

    White space before a word stays with it; the white space behind a cut is left out. See
    ``mixture`` for nulls, ties and empty tables: documents without words give no piece.
    """
    key = ["doc_id", "source", "size"]
    plan = mixture(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).where("taken > 0")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), word_count(F.col(text_col)).alias("size"))
    same = Window.partitionBy(*key)  # rows that only repeat
    own = own.withColumn("n", F.row_number().over(same.orderBy("text"))).alias("a")
    plan = plan.withColumn("n", F.row_number().over(same.orderBy("shard", F.desc("taken"), "start"))).alias("b")
    met = own.join(plan, _same("a", "b", [*key, "n"])).select("a.*", *[f"b.{c}" for c in ("shard", "copies", "start", "upto", "wrapped")])
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)

    def cut(first: Column, last: Column) -> Column:
        piece = F.array_join(F.slice(words, (first + 1).cast("int"), (last - first).cast("int")), "")
        return F.when((first == 0) & (last == F.col("size")), F.array(F.col("text"))).when(last > first, F.array(piece)).otherwise(F.array().cast("array<string>"))

    pieces = F.concat(F.array_repeat("text", F.col("copies").cast("int")), cut(F.col("start"), F.col("upto")), cut(F.lit(0), F.col("wrapped")))
    return met.select("shard", "doc_id", "source", F.posexplode(pieces).alias("nth", "text"))

"""Stored result pages: elimination brackets, pools and rankings, read from their HTML without leaving the row.

A page is one row. Its grid (columns of a bracket, cells of a matrix) becomes an array of structs
of texts and numbers (of brackets and pools in ``page_parts``, in Arrow batches); neighbours, next columns and mirrored cells are looked up in that array,
so nothing is joined or shuffled before the bouts of different pages meet. Each piece of a page is
read once: a value that is used twice is held as an element of an array, and what is parsed is exploded
with ``explode_outer``, as a filter (also one that Spark infers from ``explode``) would otherwise be moved below and parse again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from . import page_parts

#: Marks of the pages' own language, fixed values.
POOL, PISTE, TIME, REFEREE, NAME, RATE, PLACE = "뿔", "삐스트", "시간", "심판", "이름", "승률", "위"
#: Tabs of a bracket, each with four columns, and the characters that stand for others in HTML.
TABS = (128, 64, 32, 16, 8)
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    """The first number that a pattern's group finds; null without one (an empty text would go through the cast as an exception, which costs more than all else on a page)."""
    return _held(F.regexp_extract(text, pattern, group), lambda t: F.when(t != "", t.try_cast("int")))


def text_of(html: Column) -> Column:
    """Text of a piece of HTML: no tags, characters decoded, one space for white space, trimmed."""
    plain = F.regexp_replace(html, "<[^>]*>", " ")
    decoded = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), plain)
    return F.trim(F.regexp_replace(F.when(F.contains(html, F.lit("&")), decoded).otherwise(plain), r"\s+", " "))


def _element(tag: str) -> Column:
    """Pattern of an element up to the first end of its tag, with the inside as group 1; runs without ``<`` are skipped at once, nothing is tried twice."""
    return F.lit(rf"(?i)<{tag}\b[^>]*>([^<]*+(?:<(?!/{tag}>)[^<]*+)*+)</{tag}>")


def _opened(html: Column, opening: str) -> Column:
    """The page from each opening tag to the next one. The pattern is asked at the ``<`` of a tag only, which is split off and put back."""
    return F.transform(F.slice(F.split(html, f"(?is)<(?={opening})"), 2, 1_000_000_000), lambda p: F.concat(F.lit("<"), p))


def _pieces(html: Column, tag: str, name: str) -> Column:
    """The page from each opening tag of a class to the next one."""
    return _opened(html, rf"""{tag}\b[^>]*\bclass\s*=\s*["'][^"']*\b{name}\b""")


def bracket_columns(html: Column, only: int | None = None) -> Column:
    """array<struct<col, entries: array<struct<seed, name, aff, won, lost>>>>: the columns of a bracket's page, from the left; those numbered ``only``, if given.

    An entry's ``aff`` is its team, or the score ``15 : 10`` of the bout that brought it into the column.
    """

    return F.when(html.isNotNull(), _scored(page_parts.boxed_columns(html, ENTITIES, only)["columns"]))


def _scored(columns: Column) -> Column:
    def read(e: Column) -> Column:
        score = lambda i: F.when(F.contains(e["aff"], F.lit(":")), _number(e["aff"], r"(\d+)\s*:\s*(\d+)", i))
        return F.struct(e["seed"].alias("seed"), e["name"].alias("name"), e["aff"].alias("aff"), score(1).alias("won"), score(2).alias("lost"))

    return F.transform(columns, lambda c: F.struct(c["col"].alias("col"), F.transform(c["entries"], read).alias("entries")))


def needed_pages(pages: DataFrame, keys: list[str], tab: str = "tab", html: str = "html") -> DataFrame:
    """``pages`` of the tabs that a bracket of its size has, and ``size``; the others are never parsed.

    The bracket starts in the greatest tab that has entries in its first column, and its size is their
    number, else two to the power that the page names (``firstGrpSize``), else 8. It
    needs the tab of 8 and every smaller tab than its size. Only entry marks are counted here, on text, and once for each page.
    """
    first = F.get(F.filter(_pieces(F.col(html), "td", "row_table"), lambda p: p.rlike(r"(?i)^<td\b[^>]*\brow0*1\b")), F.lit(0))
    entries = F.size(_pieces(F.coalesce(first, F.lit("")), "tr", "user_box"))
    return _needed(pages.withColumn("size", _held(entries, lambda n: _size(n, F.col(html)))), keys, tab)


def _size(entries: Column, html: Column) -> Column:
    power = _number(html, r"""(?i)<input\b[^>]*\bname\s*=\s*["']?firstGrpSize\b[^>]*\bvalue\s*=\s*["']?(\d+)""")
    return F.when(entries > 0, entries).otherwise(_held(power, lambda p: F.when(p > 0, F.pow(F.lit(2), p).cast("int"))))


def _needed(sized: DataFrame, keys: list[str], tab: str) -> DataFrame:
    greatest = F.max_by("size", F.when(F.col("size").isNotNull(), F.col(tab))).over(Window.partitionBy(*keys))  # the tabs of one bracket
    met = sized.withColumn("size", F.coalesce(greatest, F.lit(8)))
    return met.where((F.col(tab) == 8) | (F.col(tab).isin(*TABS) & (F.col(tab) <= F.col("size"))))


def _needed_columns(pages: DataFrame, keys: list[str], tab: str, html: str, only: int | None = None) -> DataFrame:
    """keys, tab, columns: ``bracket_columns`` of the pages needed, without scores. Each page is read once, size and columns together, and only what was read is sorted by bracket, no page."""
    read = pages.select(*keys, F.col(tab).alias("tab"), F.col(html).alias("__html"), page_parts.boxed_columns(F.col(html), ENTITIES, only).alias("r"))
    sized = read.select(*keys, "tab", F.explode_outer(F.array(F.struct(_size(F.col("r.first"), F.col("__html")).alias("size"), F.col("r.columns").alias("columns")))).alias("s"))
    return _needed(sized.select(*keys, "tab", "s.size", "s.columns"), keys, "tab")


def _who(entry: Column) -> Column:
    team = F.when(~F.contains(entry["aff"], F.lit(":")), entry["aff"])
    return F.when(entry["name"].isNotNull(), F.struct(entry["seed"].alias("seed"), entry["name"].alias("name"), team.alias("team")))


def round_of_size(size: Column) -> Column:
    """Name of the round of so many players."""
    return F.when(size == 2, V.FINAL).when(size == 4, V.SEMIFINAL).otherwise(F.concat(size.cast("string"), F.lit("강")))


def page_bouts(pages: DataFrame, keys: list[str], tab: str = "tab", html: str = "html") -> DataFrame:
    """keys, round_size, round, match, p1, p2, p1_score, p2_score, winner, is_bye of the brackets on ``pages``.

    Neighbours of a column meet. Their score stands in the next column, behind the winner's name (of
    equal names there the last counts), and is exchanged where that is the second. A missing side
    is a bye and the other goes on; without a score there is no winner. Column 4 with a single entry holds the
    champion, no bout. Of the same bout in several tabs the one of the smallest tab with a score
    stays, without any score the one of the greatest tab. Pages without a bracket, and null ones, give no rows.
    """
    grid = _needed_columns(pages, keys, tab, html).select(*keys, "tab", F.explode_outer(F.array(_scored(F.col("columns")))).alias("columns"))
    cols = grid.select(*keys, "tab", "columns", F.explode_outer("columns").alias("c"))  # outer: an inferred filter would parse twice
    later = F.get(F.filter("columns", lambda d: d["col"] == F.col("c.col") + 1), F.lit(0))["entries"]
    cols = cols.select(*keys, "tab", F.col("c.col").alias("col"), F.col("c.entries").alias("e"), F.coalesce(later, F.expr("slice(c.entries, 1, 0)")).alias("later"))
    cols = cols.where(F.col("col").between(1, 4) & (F.size("e") > 0) & ~((F.col("col") == 4) & (F.size("e") == 1)))
    pair = cols.select(*keys, "tab", "col", "later", F.explode(F.transform(F.sequence(F.lit(0), F.size("e") - 1, F.lit(2)), lambda i: F.struct((i / 2).cast("int").alias("i"), F.get("e", i).alias("x"), F.get("e", i + 1).alias("y")))).alias("m"))

    both = F.col("m.x.name").isNotNull() & F.col("m.y.name").isNotNull()

    def behind(side: str) -> Column:
        named = F.filter("later", lambda e: (e["name"] == F.col(f"m.{side}.name")) & e["won"].isNotNull())
        return F.when(both & (F.size(named) > 0), F.element_at(named, -1))

    pair = pair.withColumn("sx", behind("x")).withColumn("sy", behind("y"))
    one = F.when(F.col("sx").isNotNull(), F.col("sx.won")).otherwise(F.col("sy.lost"))
    two = F.when(F.col("sx").isNotNull(), F.col("sx.lost")).otherwise(F.col("sy.won"))
    winner = F.when(F.col("m.y.name").isNull(), F.col("m.x.name")).when(F.col("m.x.name").isNull(), F.col("m.y.name")).when(one > two, F.col("m.x.name")).when(one.isNotNull(), F.col("m.y.name"))
    size = (F.col("tab") / F.pow(F.lit(2), F.col("col") - 1)).cast("int")
    found = pair.select(*keys, "tab", size.alias("round_size"), (F.col("m.i") + 1).alias("match"), F.struct(_who(F.col("m.x")).alias("p1"), _who(F.col("m.y")).alias("p2"), one.alias("p1_score"), two.alias("p2_score"), winner.alias("winner"), (~both).alias("is_bye")).alias("b"))
    scored = F.col("b.p1_score").isNotNull()
    best = F.max_by("b", F.struct(scored.cast("int").alias("s"), F.when(scored, -F.col("tab")).otherwise(F.col("tab")).alias("t")))
    return found.groupBy(*keys, "round_size", "match").agg(best.alias("b")).select(*keys, "round_size", round_of_size(F.col("round_size")).alias("round"), "match", "b.*")


def seeding(pages: DataFrame, keys: list[str], tab: str = "tab", html: str = "html") -> DataFrame:
    """keys, seed, name, team, is_bye: the first column of the greatest tab needed; entries without a number go."""
    entries = F.filter(F.get("columns", F.lit(0))["entries"], lambda e: e["seed"] > 0)
    rows = _needed_columns(pages, keys, tab, html, 1).select(*keys, "tab", F.explode_outer(F.array(entries)).alias("e")).where(F.size("e") > 0).groupBy(*keys, "tab").agg(F.flatten(F.collect_list("e")).alias("e"))  # the entries of one page
    top = rows.groupBy(*keys).agg(F.max_by("e", "tab").alias("e")).select(*keys, F.explode("e").alias("e"))
    return top.select(*keys, "e.seed", "e.name", F.when(~F.contains("e.aff", F.lit(":")), F.col("e.aff")).alias("team"), F.col("e.name").isNull().alias("is_bye"))


def champions(pages: DataFrame, keys: list[str], tab: str = "tab", html: str = "html") -> DataFrame:
    """keys, seed, name: the first entry of the fourth column of the tab of 8."""
    entry = F.slice(F.get(page_parts.boxed_columns(F.col(html), ENTITIES, 4)["columns"], F.lit(0))["entries"], 1, 1)
    return pages.where(F.col(tab) == 8).select(*keys, F.explode_outer(entry).alias("e")).where("e.name is not null").select(*keys, "e.seed", "e.name")


def _tables(html: Column) -> Column:
    return F.regexp_extract_all(html, _element("table"), F.lit(1))


def _cells(row: Column, tag: str = "td") -> Column:
    return F.transform(F.regexp_extract_all(row, _element(tag), F.lit(1)), text_of)


def _rows(table: Column) -> Column:
    """Cells of each row that has any."""
    return F.filter(F.transform(F.regexp_extract_all(table, _element("tr"), F.lit(1)), lambda r: _cells(r)), lambda r: F.size(r) > 0)


def _pools(pages: DataFrame, keys: list[str], html: str, least_cells: int, matrix: bool) -> DataFrame:
    """keys, p (number, opponents, items, rows): the pools of each page."""

    def numbered(b: Column) -> Column:
        number = _number(F.get(b["items"], F.lit(0)), rf"{POOL}\s*(\d+)")
        return F.struct(number.alias("number"), F.size(F.filter(b["heads"], lambda h: h.rlike(r"^\d+$"))).alias("opponents"), b["items"].alias("items"), b["rows"].alias("rows"))

    blocks = page_parts.list_tables(F.col(html), POOL, ENTITIES, least_cells, matrix)
    tabled = F.filter(blocks, lambda b: F.array_contains(b["heads"], NAME) & F.array_contains(b["heads"], RATE))
    pools = F.filter(F.transform(tabled, numbered), lambda b: b["number"].isNotNull())
    return pages.select(*keys, F.explode_outer(pools).alias("p")).where("p is not null")


def _fits(cells: Column) -> Column:
    name = F.get(cells, F.lit(1))["text"]
    return (F.size(cells) > 0) & (name != "") & ~name.rlike(r"^\d+$")


def _position(cells: Column, at: Column) -> Column:
    own = F.get(cells, F.lit(0))["number"]
    return F.when(own > 0, own).otherwise(at + 1)


def _told(cells: Column) -> list[Column]:
    """wins, losses, indicator, touches and rank, from the last four cells of a row."""
    last = lambda i: F.get(cells, F.size(cells) - i)
    whole = lambda i: F.coalesce(last(i)["number"], F.lit(0))
    total = F.coalesce(_number(last(4)["text"], r"^[^/]*/(-?\d+)"), F.lit(0))
    return [whole(4).alias("wins"), (total - whole(4)).alias("losses"), whole(3).alias("indicator"), whole(2).alias("touches"), whole(1).alias("rank")]


def pool_results(pages: DataFrame, keys: list[str], html: str = "html", least_cells: int = 10) -> DataFrame:
    """keys, pool_number, position, name, team, wins, losses, indicator, touches, rank: a row for each result of ``pool_matrices``.

    The cells of the matrix, whose number is the square of the rows', aren't told.
    """
    rows = _pools(pages, keys, html, least_cells, False).select(*keys, F.col("p.number").alias("pool_number"), F.posexplode_outer("p.rows").alias("at", "r")).where(_fits(F.col("r")))
    r = F.col("r")
    return rows.select(*keys, "pool_number", _position(r, F.col("at")).alias("position"), r[1]["text"].alias("name"), r[2]["text"].alias("team"), *_told(r))


def pool_matrices(pages: DataFrame, keys: list[str], html: str = "html", least_cells: int = 10) -> DataFrame:
    """keys, pool_number, piste, time, referee, results (position, name, team, scores, wins, losses, indicator, touches, rank) of each pool.

    A pool is a list whose first item names it, with the next table behind, if that has columns for name and rate. A cell
    ``V`` is a win by 5, ``V4`` by 4; empty cells and ``-`` are losses without a touch, other
    cells losses by their number. The cell of one's own position is null, whatever stands there. Rows of fewer than
    ``least_cells`` cells, without a name, or named by digits alone, go.
    """

    def told(mark: str) -> Column:
        item = F.element_at(F.filter("p.items", lambda i: F.contains(i, F.lit(mark))), -1)
        return F.when(F.exists("p.items", lambda i: F.contains(i, F.lit(mark))), F.trim(F.regexp_replace(item, rf"{mark}\s*", ""))).otherwise("")

    def result(s: Column) -> Column:
        cells, position = s["r"], s["position"]

        def cell(c: Column, i: Column) -> Column:
            won = F.substring(c["text"], 1, 1).isin("V", "v")  # not upper(): it took most of the time of a page
            touches = F.when(F.length(c["text"]) > 1, _number(c["text"], r"^[Vv](\d+)"))
            score = F.when(won, _held(touches, lambda t: F.when(t > 0, t).otherwise(5))).otherwise(F.coalesce(c["number"], F.lit(0)))
            return F.when(i != position - 1, F.struct(F.when(won, "V").otherwise("L").alias("type"), score.alias("score")))

        none = F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("number"))
        shown = F.transform(F.sequence(F.lit(0), F.greatest(F.col("p.opponents"), F.lit(1)) - 1), lambda i: F.coalesce(F.get(cells, i + 3), none))
        scores = F.transform(shown, cell)
        return F.struct(position.alias("position"), cells[1]["text"].alias("name"), cells[2]["text"].alias("team"), F.when(F.col("p.opponents") > 0, scores).otherwise(F.slice(scores, 1, 0)).alias("scores"), *_told(cells))

    fit = F.filter(F.transform("p.rows", lambda r, at: F.struct(r.alias("r"), _position(r, at).alias("position"))), lambda s: _fits(s["r"]))
    pools = _pools(pages, keys, html, least_cells, True)
    one = F.struct(F.col("p.number").alias("pool_number"), told(PISTE).alias("piste"), told(TIME).alias("time"), told(REFEREE).alias("referee"), F.transform(fit, result).alias("results"))
    return pools.select(*keys, F.explode_outer(F.array(one)).alias("__p")).select(*keys, "__p.*")


def matrix_bouts(pools: DataFrame, keys: list[str], results: str = "results") -> DataFrame:
    """keys, p1, p2, p1_score, p2_score, winner: one bout for each cell above the diagonal, the other score from the mirrored cell (0 where it is null)."""
    rows = pools.select(*keys, F.col(results).alias("all"), F.posexplode(results).alias("i", "a"))
    rows = rows.select(*keys, "all", "i", "a", F.posexplode("a.scores").alias("j", "cell")).where("i < j and cell is not null")
    rows = rows.withColumn("b", F.get("all", F.col("j"))).where(F.col("b").isNotNull())
    side = lambda s: F.struct(F.lit(None).cast("int").alias("seed"), F.col(f"{s}.name").alias("name"), F.col(f"{s}.team").alias("team"))
    back = F.coalesce(F.get("b.scores", F.col("i"))["score"], F.lit(0))
    return rows.select(*keys, side("a").alias("p1"), side("b").alias("p2"), F.col("cell.score").alias("p1_score"), back.alias("p2_score"), F.when(F.col("cell.type") == "V", F.col("a.name")).otherwise(F.col("b.name")).alias("winner"))


def ranking_rows(pages: DataFrame, keys: list[str], html: str = "html", popup: str | None = None) -> DataFrame:
    """keys, rank, name, team: the first table that has ranked rows (inside the element with id ``popup``, if given).

    ``3위`` is rank 3; rows of fewer than three cells, without a rank above 0 or without a name go.
    """
    part = F.col(html) if popup is None else F.regexp_extract(html, rf"""(?is)\bid\s*=\s*["']{popup}["'](.*)$""", 1)
    rank = lambda r: _number(F.replace(r[0], F.lit(PLACE), F.lit("")), r"^(\d+)", 1)
    ranked = lambda t: F.filter(F.transform(F.filter(_rows(t), lambda r: F.size(r) >= 3), lambda r: F.struct(rank(r).alias("rank"), r[1].alias("name"), r[2].alias("team"))), lambda s: (s["rank"] > 0) & (s["name"] != ""))
    found = F.get(F.filter(F.transform(_tables(part), ranked), lambda t: F.size(t) > 0), F.lit(0))
    return pages.select(*keys, F.explode(found).alias("r")).select(*keys, "r.*")


def pool_total(pages: DataFrame, keys: list[str], through: str = "qualified", out: str = "eliminated", popup: str = "layer_final_ranking") -> DataFrame:
    """keys, rank, name, team, status: those who go on and those who are out, from a page with both views of the ranking."""
    some = lambda html, status: ranking_rows(pages, keys, html, popup).withColumn("status", F.lit(status))
    return some(through, "진출").unionByName(some(out, "탈락"))


def winner_cells(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, cell, seed, name, team, won, lost: the table cells that read ``seed name team 15:10``."""
    cells = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<td\b[^>]*>((?:(?!<td\b|</td>).)*)</td>"), F.lit(1))
    rows = pages.select(*keys, F.posexplode(F.transform(cells, text_of)).alias("cell", "t"))
    whole = r"(?s)^(\d+)\s+([가-힣a-zA-Z]+)\s*(.*?)\s*(\d+)\s*:\s*(\d+)"
    at = lambda i: F.regexp_extract("t", whole, i)
    return rows.where(F.col("t").rlike(whole)).select(*keys, "cell", at(1).try_cast("int").alias("seed"), at(2).alias("name"), at(3).alias("team"), at(4).try_cast("int").alias("won"), at(5).try_cast("int").alias("lost"))

"""N-gram Jaccard join: classes of documents linked by similar shingle sets.

The method skips along set relations. Every set is sorted in one global order (of hashes) and
cut into blocks by position in that order. The index has one list per block content. If two
sets differ in d elements at most, they differ in d blocks at most, so a set with d + m blocks in
use shares m lists with each partner. Of its lists, a set therefore skips those that it has alone
and the m - 1 longest ones, in one order for all sets: the shortest list that two partners share
is skipped by neither, while lists that come of passages in many documents are left out. The first
set of what stays of a list is its leader. Each member is compared with its leader alone; those linked to it need no
further answers. For leaders with members left over, the answers already computed settle
most of the rest: members are put in blocks by distance from the leader, and two blocks are
skipped if their distances differ by more than the threshold (the Jaccard distance is a
metric), if their sizes rule links out, or if all their members are in one class already.
The remaining pairs of blocks are compared at once, and yield links between classes only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .shingles import mix, set_id, shingle_sets

#: Members that one task compares with a leader at a time.
SHARE = 256
#: Members of a block at most, their shingles in sum, and shingles compared at once.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
SLAB = 4096
#: A set has lists of three schemes in a row at most, told apart by this many remainders.
SCHEMES = 4


@lru_cache(8)
def classes(num: int, den: int) -> list[int]:
    """First sizes of the size classes; each is half as large again as the one before."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, starts[-1] * max(3 * num, 2 * den + num) // (2 * num)))
    return starts


def schemes(n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(scheme, blocks, differences) under which a set of n elements is indexed.

    Scheme 2c holds the pairs inside size class c; scheme 2c + 1 those of class c with c + 1.
    Sizes of a linked pair differ by the factor num/den at most.
    """
    starts = classes(num, den)
    c = int(np.searchsorted(starts, n, "right")) - 1

    def scheme(tag: int, total: int) -> tuple[int, int, int]:
        d = (den - num) * total // (den + num)
        return tag, 1 if d == 0 else d + 2 + d // 3, d

    last = starts[c + 1] - 1
    found = [scheme(2 * c, 2 * last)]
    if n * den >= num * starts[c + 1]:
        found.append(scheme(2 * c + 1, last + last * den // num))
    if c:
        below = starts[c] - 1
        if n * num <= below * den:
            found.append(scheme(2 * c - 1, below + below * den // num))
    return found


def block_keys(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(lists that a set belongs to, how many of that scheme it may skip); a list's scheme is in its low bits.

    A set with more blocks in use than differences has a used block in common with every
    partner, and may skip as many as it has beyond one. Only sets with fewer also take the
    lists of unused blocks; they skip none.
    """
    out, spare = [], []
    mixed = mix(s + np.uint64(1))
    for tag, blocks, d in schemes(len(s), num, den):
        at = ((s >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)  # s is sorted, so is at
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        with np.errstate(over="ignore"):
            content = np.add.reduceat(mixed, first)
            place = at[first]
            if len(first) <= d:
                content = np.r_[content, np.zeros(blocks - len(first), np.uint64)]
                place = np.r_[place, np.setdiff1d(np.arange(blocks), place)]
            where = np.uint64(tag << 40) + place.astype(np.uint64)
            key = mix(content * np.uint64(0x9E3779B97F4A7C15) + mix(where))
            out.append(key & ~np.uint64(SCHEMES - 1) | np.uint64(tag % SCHEMES))
            spare.append(np.full(len(key), max(len(first) - d - 1, 0), np.int32))
    return np.concatenate(out), np.concatenate(spare)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``edges`` (a, b): label is the least node of the component.

    Labels spread to neighbours and then jump to their own label's label, so the rounds grow
    with the logarithm of a component's width; each round ends in a table on shared files.
    """
    pairs = edges.where("a <> b")
    pairs = materialize(pairs.union(pairs.select("b", "a")).distinct(), "cc-edges")
    labels = materialize(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "cc-labels")
    while True:
        heard = pairs.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        spread = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = spread.join(target, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), (F.least("label", F.coalesce("further", "label")) < F.col("old")).alias("moved"))
        jumped = materialize(jumped, "cc-labels")
        labels = jumped.select("node", "label")
        if not jumped.where("moved").limit(1).count():
            return labels


def _named(rows: DataFrame) -> DataFrame:
    """rep, hash, text: rows with an id as they are (hash 0), and one row for each text without an id (hash its hash)."""
    known = rows.where("doc_id is not null").select(F.col("doc_id").alias("rep"), F.lit(0).cast("long").alias("hash"), "text")
    return known.union(rows.where("doc_id is null").select("doc_id", F.xxhash64("text").alias("hash"), "text").dropDuplicates(["hash"]))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted's columns and the text whose set is wanted's sid; wanted has (sid, rep, hash)."""
    return wanted.join(docs, wanted["rep"].eqNullSafe(docs["rep"]) & (wanted["hash"] == docs["hash"])).drop(docs["rep"], docs["hash"])


def _star_links(docs: DataFrame, stars: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """leader, member, inter, n_a, n_b: every member compared with its leader."""
    count = stars.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARE)).cast("long").alias("shares"))
    share = F.pmod(F.xxhash64("member"), F.col("shares"))
    dealt = materialize(stars.join(count, "leader").select("leader", "member", share.alias("share")), "jaccard-stars")
    members = dealt.select("leader", "share", F.lit(1).alias("role"), F.col("member").alias("sid"))
    leaders = dealt.select("leader", "share").distinct().select("leader", "share", F.lit(0).alias("role"), F.col("leader").alias("sid"))
    rows = members.union(leaders).join(sets.select("sid", "rep", "hash"), "sid")
    rows = _texts(docs, rows).select("leader", "share", "role", "sid", "text")
    rows = rows.repartition("leader", "share").sortWithinPartitions("leader", "share", "role")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, head = None, None
        for batch in batches:
            out = []
            found = shingle_sets(batch["text"].tolist(), width)
            for leader, share, role, sid, s in zip(batch["leader"], batch["share"], batch["role"], batch["sid"], found, strict=True):
                if set_id(s) != sid:  # another text under the same id
                    continue
                if role == 0:
                    group, head = (leader, share), s
                elif group == (leader, share):
                    out.append((leader, sid, len(np.intersect1d(head, s, assume_unique=True)), len(head), len(s)))
            yield pd.DataFrame(out, columns=["leader", "member", "inter", "n_a", "n_b"])

    return rows.mapInPandas(run, "leader long, member long, inter long, n_a long, n_b long")


def _linked(inter: Column, a: Column, b: Column, num: int, den: int) -> Column:
    return inter * den >= (a + b - inter) * num


def _leftover_links(docs: DataFrame, stars: DataFrame, labels: DataFrame, sets: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """a, b: links between classes among the members of leaders that don't have all of them."""
    label = labels.select(F.col("node").alias("member"), "label")
    known = stars.join(label, "member", "left").withColumn("label", F.coalesce("label", "member"))
    known = known.withColumn("dist", F.lit(1.0) - F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter")))
    split = known.groupBy("leader").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("leader")
    known = materialize(known.join(split, "leader").withColumn("ring", F.floor(F.col("dist") / (1 - num / den)).cast("int")), "jaccard-left")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n_b") / F.lit(BLOCK_SHINGLES)))
    rings = known.groupBy("leader", "ring").agg(parts.cast("int").alias("parts"))
    block = F.col("ring") * 100_000 + F.pmod(F.xxhash64("member", "leader"), F.col("parts")).cast("int")
    known = materialize(known.join(rings, ["leader", "ring"]).withColumn("block", block).drop("parts"), "jaccard-blocks")
    blocks = known.groupBy("leader", "block").agg(
        F.min("dist").alias("d0"), F.max("dist").alias("d1"), F.min("n_b").alias("n0"), F.max("n_b").alias("n1"), F.min("label").alias("l0"), F.max("label").alias("l1"),
    )
    x, y = blocks.alias("x"), blocks.alias("y")
    far = 1 - num / den + 1e-9
    near = (F.col("y.d0") - F.col("x.d1") <= far) & (F.col("x.d0") - F.col("y.d1") <= far)
    sizes = (F.col("x.n1") * den >= F.col("y.n0") * num) & (F.col("y.n1") * den >= F.col("x.n0") * num)
    apart = ~((F.col("x.l0") == F.col("x.l1")) & (F.col("y.l0") == F.col("y.l1")) & (F.col("x.l0") == F.col("y.l0")))
    pairs = x.join(y, (F.col("x.leader") == F.col("y.leader")) & (F.col("x.block") <= F.col("y.block")) & near & sizes & apart)
    pairs = materialize(pairs.select("x.leader", F.col("x.block").alias("i"), F.col("y.block").alias("j")), "jaccard-pairs")
    one = pairs.select("leader", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side"))
    two = pairs.where("i < j").select("leader", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side"))
    wanted = known.select("member").distinct().withColumnRenamed("member", "sid").join(sets.select("sid", "rep", "hash"), "sid")
    texts = _texts(docs, wanted).select(F.col("sid").alias("member"), "text")
    rows = one.union(two).join(known.select("leader", "block", "member", "label"), ["leader", "block"]).join(texts, "member")
    rows = rows.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "side")

    def compare(side: list[int], sids: list[int], label: list[int], found: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links of one pair of blocks, or of one block with itself, that join classes."""
        tokens, at, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(found)), [len(s) for s in found])
        shared = times[at] > 1
        column, wide = (np.cumsum(times > 1) - 1)[at[shared]], int((times > 1).sum())
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[shared][order]
        left = np.flatnonzero(np.array(side) == side[0])
        right = np.flatnonzero(np.array(side) != side[0]) if side[-1] != side[0] else left
        inter = np.zeros((len(left), len(right)), np.float32)
        for a in range(0, wide, SLAB):
            lo, hi = np.searchsorted(column, [a, a + SLAB])
            held = np.zeros((len(found), min(SLAB, wide - a)), np.float32)
            held[owner[lo:hi], column[lo:hi] - a] = 1
            inter += held[left] @ held[right].T
        size = np.array([len(s) for s in found], np.float64)
        names, of = np.unique(label, return_inverse=True)
        link = inter * den >= (size[left, None] + size[None, right] - inter) * num
        link &= of[left, None] != of[None, right]
        parent = list(range(len(names)))

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        out = []
        for p, q in zip(*np.nonzero(link), strict=True):
            u, v = root(of[left[p]]), root(of[right[q]])
            if u != v:
                parent[u] = v
                out.append((sids[left[p]], sids[right[q]]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held = None, ([], [], [], [])
        for batch in batches:
            out = []
            found = shingle_sets(batch["text"].tolist(), width)
            for leader, i, j, side, sid, label, s in zip(batch["leader"], batch["i"], batch["j"], batch["side"], batch["member"], batch["label"], found, strict=True):
                if set_id(s) != sid:
                    continue
                if group != (leader, i, j):
                    if len(held[0]) > 1:
                        out += compare(*held)
                    group, held = (leader, i, j), ([], [], [], [])
                for into, v in zip(held, (side, sid, label, s), strict=True):
                    into.append(v)
            yield pd.DataFrame(out, columns=["a", "b"])
        if len(held[0]) > 1:
            yield pd.DataFrame(compare(*held), columns=["a", "b"])

    return rows.select("leader", "i", "j", "side", "member", "label", "text").mapInPandas(run, "a long, b long")


def jaccard_classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash for every row.

    Two documents link when den * intersection >= num * union of their sets of distinct
    ``width``-word shingles; component_id is the least doc_id that links reach. A text without
    words, or null, is linked with nothing and is its own component. Rows of equal sets collapse
    into one before any comparison; ids that repeat are told apart by their sets. A null id
    counts as no candidate for component_id unless there is no other; a set that only rows
    without an id hold is compared like the others, its text found by hash. An empty table gives an
    empty result; other columns are ignored. Sets are told apart by 64-bit hashes. Long texts are
    shingled whole; of equal classes' ids the least names the class, so there are no ties.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(len(s), set_id(s) if len(s) else None) for s in shingle_sets(batch["text"].tolist(), width)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "n_shingles": [n for n, _ in found], "sid": pd.array([d for _, d in found], "Int64")})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()  # equal sets of a task enter the lists once
        for batch in batches:
            texts = batch["text"].tolist()
            for a in range(0, len(texts), 500):
                keys, spare, sids = [], [], []
                for s in shingle_sets(texts[a : a + 500], width):
                    if not len(s):
                        continue
                    sid = set_id(s)
                    if sid in met:
                        continue
                    met.add(sid)
                    lists, skips = block_keys(s, num, den)
                    keys.append(lists.view(np.int64))
                    spare.append(skips)
                    sids.append(np.full(len(keys[-1]), sid, np.int64))
                if len(met) > 1_000_000:
                    met.clear()
                if keys:
                    yield pd.DataFrame({"key": np.concatenate(keys), "sid": np.concatenate(sids), "spare": np.concatenate(spare)})

    facts = materialize(rows.withColumn("text_hash", F.xxhash64("text")).mapInPandas(describe, f"doc_id {kind}, text_hash long, n_shingles long, sid long"), "jaccard-docs")
    sets = facts.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("text_hash").alias("hash"), F.max("n_shingles").alias("n"))
    sets = materialize(sets.withColumn("hash", F.when(F.col("rep").isNull(), F.col("hash")).otherwise(F.lit(0))), "jaccard-sets")
    texts = _named(rows)
    lists = rows.select("text").mapInPandas(index, "key long, sid long, spare int")
    same = Window.partitionBy("key")
    shared = lists.withColumns({"leader": F.min("sid").over(same), "last": F.max("sid").over(same), "members": F.count(F.lit(1)).over(same)})
    shared = shared.where("leader <> last").groupBy("key", "sid", "spare").agg(F.max("members").alias("members"))
    longest = Window.partitionBy("sid", F.col("key").bitwiseAND(SCHEMES - 1)).orderBy(F.desc("members"), "key")
    shared = shared.withColumn("place", F.row_number().over(longest)).where("place > spare")
    stars = shared.withColumn("leader", F.min("sid").over(same)).where("leader < sid").select("leader", F.col("sid").alias("member")).distinct()
    compared = materialize(_star_links(texts, materialize(stars, "jaccard-lists"), sets, width), "jaccard-compared")
    links = compared.where(_linked(F.col("inter"), F.col("n_a"), F.col("n_b"), num, den)).select(F.col("leader").alias("a"), F.col("member").alias("b"))
    labels = components(links)
    more = materialize(_leftover_links(texts, compared, labels, sets, width, num, den), "jaccard-more")
    if more.limit(1).count():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    named = sets.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = materialize(named.join(least, "label").select("sid", "component_id"), "jaccard-classes")
    out = facts.join(found, "sid", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the least id of their class, with all their columns.

    Rows are told apart by id and text. Texts without words all stay.
    """
    gone = jaccard_classes(docs, width, num, den, id_col, text_col).where("doc_id <> component_id").select("doc_id", "text_hash").distinct().alias("b")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash")).alias("a")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.hash") == F.col("b.text_hash"))
    return rows.join(gone, same, "left_anti").select("row.*")

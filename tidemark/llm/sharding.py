"""Balanced label propagation: equal texts gather in few shards while row counts stay even."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import running_total, slice_count, slice_of
from tidemark.session import cut_lineage

_CLUSTER = ["key", "chunk"]


def _per_shard(values: dict[int, int], shards: int):
    """A literal array with one number per shard; a driver-side table of ``shards`` numbers."""
    return F.array(*[F.lit(int(values.get(s, 0))).cast("long") for s in range(shards)])


def _at(array, index):
    return F.element_at(array, (index + 1).cast("int"))


def _merged(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*_CLUSTER, "shard").agg(F.sum("n").alias("n"))


def _loads(cells: DataFrame) -> dict[int, int]:
    return {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row per shard


def propagate(cells: DataFrame, quota: dict[int, int], shards: int, rounds: int | None = None) -> DataFrame:
    """Labels of the members of each cluster move to the shard where most of them can meet.

    A cell is the number of a cluster's members with one label; members of a cluster are all linked with
    each other, so votes are cell counts. The wanted shard is that with the largest reach: members there
    plus members that still fit. A wish is granted in part where the shard's free quota ends, so a round
    never overfills a shard. A cluster takes what it is granted only if fewer of its links are cut then, that
    is if the sum of its squared cells rises. So no move can alternate, the cut falls with every round, and
    the rounds end by themselves where nothing is taken. A caller may stop after ``rounds``; ``assign_shards``
    does not.
    """
    load, done = _loads(cells), 0
    while done != rounds:
        free = _per_shard({s: max(0, quota[s] - load.get(s, 0)) for s in quota}, shards)
        mine = Window.partitionBy(*_CLUSTER)
        voted = cells.withColumn("total", F.sum("n").over(mine)).withColumn(
            "reach", F.col("n") + F.least(_at(free, F.col("shard")), F.col("total") - F.col("n")))
        best = F.max(F.struct("reach", "n", F.xxhash64("key", "chunk", "shard").alias("tie"), "shard")).over(mine)
        voted = voted.withColumn("best", best).withColumn("to", F.col("best.shard"))
        moves = (F.col("shard") != F.col("to")) & (F.col("n") < F.col("best.reach"))
        wishes = running_total(voted.where(moves).select(*_CLUSTER, "shard", "n", "to"), ["to"], ["key", "chunk", "shard"],
                               F.col("n"), "prior", together=2)
        granted = wishes.withColumn(
            "go", F.greatest(F.lit(0), F.least(F.col("n"), _at(free, F.col("to")) - F.col("prior"))))
        n, go, none = F.col("n"), F.col("go"), F.lit(0).cast("long")
        stay = voted.where(~moves).select(*_CLUSTER, "shard", n.alias("old"), n.alias("new"), none.alias("went"))
        rest = granted.select(*_CLUSTER, "shard", n.alias("old"), (n - go).alias("new"), none.alias("went"))
        moved = granted.select(*_CLUSTER, F.col("to").alias("shard"), none.alias("old"), go.alias("new"), go.alias("went"))
        parts = stay.unionByName(rest).unionByName(moved).groupBy(*_CLUSTER, "shard").agg(*[F.sum(c).alias(c) for c in ("old", "new", "went")])
        gain = F.sum(F.col("new") * F.col("new") - F.col("old") * F.col("old")).over(mine)
        parts = parts.withColumn("taken", gain > 0)
        parts = cut_lineage(parts.select(*_CLUSTER, "shard", F.when(F.col("taken"), F.col("new")).otherwise(F.col("old")).alias("n"),
                                         F.when(F.col("taken"), F.col("went")).otherwise(0).alias("went")).where("n > 0"))
        if not parts.agg(F.sum("went")).first()[0]:
            return cells
        cells = parts.drop("went")
        load, done = _loads(cells), done + 1
    warnings.warn(f"rows still moved after {rounds} rounds; some linked rows may be apart that could meet")
    return cells


def _settle(cells: DataFrame, quota: dict[int, int], shards: int) -> DataFrame:
    """Move what exceeds a shard's quota into free places of the others."""
    load = _loads(cells)
    if all(load.get(s, 0) <= quota[s] for s in quota):
        return cells
    cells = running_total(cells, ["shard"], _CLUSTER, F.col("n"), "prior")
    keep = F.greatest(F.lit(0), F.least(F.col("n"), _at(_per_shard(quota, shards), F.col("shard")) - F.col("prior")))
    cells = cells.withColumn("keep", keep)
    over = running_total(cells.withColumn("n", F.col("n") - F.col("keep")).where("n > 0").select(*_CLUSTER, "shard", "n"),
                         [], ["key", "chunk", "shard"], F.col("n"), "prior")
    bounds, at = [], 0
    for s in range(shards):
        room = max(0, quota[s] - load.get(s, 0))
        bounds.append(F.struct(F.lit(s).alias("s"), F.lit(at).cast("long").alias("lo"), F.lit(at + room).cast("long").alias("hi")))
        at += room
    lands = over.withColumn("b", F.explode(F.array(*bounds))).select(
        *_CLUSTER, F.col("b.s").alias("shard"),
        (F.least(F.col("prior") + F.col("n"), F.col("b.hi")) - F.greatest(F.col("prior"), F.col("b.lo"))).alias("n"))
    return _merged(cells.select(*_CLUSTER, "shard", F.col("keep").alias("n")).unionByName(lands).where("n > 0"))


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row in one of ``shards`` shards, counts at most one apart, equal texts together.

    Rows with equal texts (null counts as empty) are linked. Groups above a shard's quota are first cut
    into chunks of that size. Labels of linked rows start by hash and move by ``propagate``; rows without
    links fill the free places. Returns doc_id, size (UTF-8 bytes plus 16), text_crc32, law ('rows'),
    shard, slot (gapless per shard) and grown_shard (null: the law is not by key). Repeated rows and null
    ids are rows of their own; extra columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slices = slice_count(spark)
    base = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_key"), F.monotonically_increasing_id().alias("row"),
        slice_of([F.col(id_col)], slices).alias("slice")))

    # members of a group per slice, their place in the group; rows without links form the group ''
    group = Window.partitionBy("text_key")
    atoms = base.groupBy("text_key", "slice").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(group))
    atoms = atoms.withColumn("key", F.when(F.col("total") == 1, F.lit("")).otherwise(F.col("text_key")))
    merged = atoms.groupBy("key", "slice").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    merged = merged.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    merged = cut_lineage(merged)
    sums = merged.agg(F.sum("n"), F.sum(F.when(F.col("key") != "", F.col("n")))).first()
    rows_all, rows_linked = sums[0] or 0, sums[1] or 0
    quota = {s: rows_all // shards + (s < rows_all % shards) for s in range(shards)}
    most = max(1, rows_all // shards)

    ranked = base.join(atoms.select("text_key", "slice", "key"), ["text_key", "slice"]).join(
        merged.select("key", "slice", "off"), ["key", "slice"])
    inside = Window.partitionBy("key", "slice").orderBy("doc_id", "row")
    ranked = ranked.withColumn("rank", F.col("off") + F.row_number().over(inside) - 1)
    ranked = cut_lineage(ranked.select(
        "doc_id", "size", "text_crc32", "row", "key", "slice",
        F.when(F.col("key") == "", F.lit(0)).otherwise(F.floor(F.col("rank") / most)).cast("long").alias("chunk"),
        F.when(F.col("key") == "", F.col("rank")).otherwise(F.col("rank") % most).cast("long").alias("place")))

    start = F.pmod(F.xxhash64("doc_id", "row", F.lit("start")), F.lit(shards)).cast("int")
    cells = ranked.where("key <> ''").groupBy(*_CLUSTER, start.alias("shard")).agg(F.count("*").alias("n"))
    cells = propagate(cut_lineage(cells), quota, shards) if rows_linked else cells
    cells = cut_lineage(_settle(cells, quota, shards))
    load = _loads(cells)

    # a cell is an interval of its cluster's places and an interval of its shard's slots
    fills, at = [], 0
    for s in range(shards):
        room = quota[s] - load.get(s, 0)
        fills.append((s, at, at + room, load.get(s, 0)))
        at += room
    slots = running_total(cells, ["shard"], _CLUSTER, F.col("n"), "slot0")
    upto = Window.partitionBy(*_CLUSTER).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("lo", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    cell = F.struct("shard", F.col("lo").alias("lo"), (F.col("lo") + F.col("n")).alias("hi"), "slot0")
    plan = slots.groupBy(*_CLUSTER).agg(F.collect_list(cell).alias("cells"))  # at most one cell per shard
    filler = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"),
                                F.lit(z).cast("long").alias("slot0")) for s, lo, hi, z in fills])

    # each slice of a group gets its clusters' cells, so that a hot group is met slice by slice
    parts = merged.where("key <> ''").select("key", "slice", F.explode(F.sequence(
        F.floor(F.col("off") / most), F.floor((F.col("off") + F.col("n") - 1) / most))).alias("chunk"))
    linked = ranked.where("key <> ''").join(parts.join(plan, _CLUSTER), ["key", "chunk", "slice"])
    out = linked.unionByName(ranked.where("key = ''").withColumn("cells", filler))
    hit = F.filter("cells", lambda c: (c["lo"] <= F.col("place")) & (F.col("place") < c["hi"]))[0]
    return out.withColumn("hit", hit).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("hit.shard").alias("shard"),
        (F.col("hit.slot0") + F.col("place") - F.col("hit.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

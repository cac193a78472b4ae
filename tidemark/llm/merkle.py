"""Merkle manifest of a dataset by time-forward processing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import landed, ranked, slice_count

ARITY = 16
HEIGHT = 3  # levels that one task climbs: a block has at most ARITY ** HEIGHT nodes


def digest(parts) -> str:
    return sha256("".join(parts).encode("ascii")).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 over the fields in order: ``-`` where null, else UTF-8 byte count, colon, value."""
    texts = [f.cast("string") for f in fields]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*told), 256)


def height_of(n: int, arity: int = ARITY, most: int | None = None) -> int:
    """Levels until one node of ``n`` remains, at most ``most``."""
    levels = 0
    while n > 1 and levels != most:
        n, levels = -(-n // arity), levels + 1
    return levels


def forward(digests: list[str], height: int, arity: int = ARITY) -> tuple[str, dict]:
    """Top digest of a block and the child digests of each inner node.

    A node's label is (its last leaf, level): children come before parents. Digests wait for their parent
    in a priority queue ordered by label, which holds fewer than ``arity`` messages per level.
    """
    size, queue, kids = len(digests), [], {}

    def send(level: int, index: int, value: str) -> None:
        parent = index // arity
        label = (min((parent + 1) * arity ** (level + 1), size), level + 1, parent)
        heapq.heappush(queue, (label, index, value))

    top = digests[0]
    for i, value in enumerate(digests):
        if height:
            send(0, i, value)
        while queue and queue[0][0][0] <= i + 1:
            label = queue[0][0]
            children = []
            while queue and queue[0][0] == label:
                children.append(heapq.heappop(queue)[2])
            kids[label] = children
            top = digest(children)
            if label[1] < height:
                send(label[1], label[2], top)
    return top, kids


def backward(size: int, kids: dict, height: int, suffix: tuple, arity: int = ARITY) -> list[tuple[list[str], list[str]]]:
    """Proof of each node of a block, in order, from the ``suffix`` of its top.

    The sweep runs from the largest label to the smallest: a node takes its suffix from the queue and sends
    each child the child's siblings, those before and those after it, followed by its own suffix.
    """
    if not height:
        return [suffix]
    proofs: list = [None] * size
    queue = [((-size, -height, 0), suffix)]
    while queue:
        (last, level, index), (before, after) = heapq.heappop(queue)
        level, index = -level, -index
        children = kids[(-last, level, index)]
        for p, _value in enumerate(children):
            own = (["".join(children[:p]), *before], ["".join(children[p + 1:]), *after])
            child = index * arity + p
            if level == 1:
                proofs[child] = own
            else:
                label = (-min((child + 1) * arity ** (level - 1), size), 1 - level, -child)
                heapq.heappush(queue, (label, own))
    return proofs


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """Each block's head row and its nodes from a stream sorted by (grp, block, pos)."""
    head, nodes = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["pos"] < 0:
                if head:
                    yield head, nodes
                head, nodes = row, []
            else:
                nodes.append(row)
    if head:
        yield head, nodes


def _in_order(rows: DataFrame) -> DataFrame:
    """Messages dealt by block and delivered by label: the shuffle's external sort holds what a task cannot."""
    return rows.repartition(slice_count(rows.sparkSession), "grp", "block").sortWithinPartitions("grp", "block", "pos")


_UP = "grp string, pos long, digest string, n long, below long"


def _climb(nodes: DataFrame, sizes: DataFrame, arity: int, height: int) -> DataFrame:
    """One row per block: the top of the block's subtree, as a node of the next tier."""
    width = arity**height
    names = ["grp", "pos", "digest", "n", "below"]

    def tops(batches):
        for head, members in _blocks(batches):
            top, _kids = forward([m["digest"] for m in members], height_of(head["n"], arity, height), arity)
            yield pa.RecordBatch.from_pydict(dict(zip(names, (
                [head["grp"]], pa.array([head["block"]], pa.int64()), [top],
                pa.array([-(-head["n"] // width)], pa.int64()), pa.array([head["n"]], pa.int64())))))

    heads = sizes.select("grp", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / width) - 1)).alias("block"))
    rows = nodes.select("grp", F.floor(F.col("pos") / width).cast("long").alias("block"), "pos", "digest", F.lit(None).cast("long").alias("n"))
    rows = rows.unionByName(heads.select("grp", F.col("block").cast("long").alias("block"), F.lit(-1).cast("long").alias("pos"),
                                         F.lit(None).cast("string").alias("digest"), "n"))
    return _in_order(rows).mapInArrow(tops, _UP)


def _descend(nodes: DataFrame, tops: DataFrame, carried: list[str], arity: int, height: int) -> DataFrame:
    """``nodes`` with their proofs, from the proofs of the tops of their blocks."""
    width = arity**height
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    schema = ", ".join(["grp string, pos long", *[f"`{c}` {kinds[c]}" for c in carried],
                        "before array<string>, after array<string>, top string"])

    def proofs(batches):
        lists = pa.list_(pa.string())
        for head, members in _blocks(batches):
            levels = height_of(head["n"], arity, height)
            _top, kids = forward([m["digest"] for m in members], levels, arity)
            found = backward(len(members), kids, levels, (head["before"], head["after"]), arity)
            step = 256  # rows of a batch: a proof takes kilobytes
            for at in range(0, len(members), step):
                some, own = members[at:at + step], found[at:at + step]
                arrays = [pa.array([m[c] for m in some], types[c]) for c in ("grp", "pos", *carried)]
                arrays += [pa.array([p[0] for p in own], lists), pa.array([p[1] for p in own], lists),
                           pa.array([head["top"]] * len(some), pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["grp", "pos", *carried, "before", "after", "top"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = {c: to_arrow_type(nodes.schema[c].dataType) for c in ("grp", "pos", *carried)}
    rows = nodes.select("grp", F.floor(F.col("pos") / width).cast("long").alias("block"), "pos", "digest",
                        *[c for c in carried if c != "digest"])
    heads = tops.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.col("below").alias("n"), "before", "after", "top")
    return _in_order(rows.unionByName(heads, allowMissingColumns=True)).mapInArrow(proofs, schema)


def _tree(nodes: DataFrame, tag: str, arity: int, height: int) -> list[DataFrame]:
    """Tiers of nodes above ``nodes`` (grp, pos, digest), one for every ``height`` levels; the last has one node a group."""
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    tiers = []
    while True:
        up = landed(_climb(nodes, sizes, arity, height), tag)
        tiers.append(up)
        if not up.where("n > 1").head(1):
            return tiers
        nodes, sizes = up, up.groupBy("grp").agg(F.count("*").alias("n"))


def _proven(leaves: DataFrame, tiers: list[DataFrame], tops: DataFrame, carried: list[str], arity: int, height: int) -> DataFrame:
    """Proofs of ``leaves``; ``tops`` has (grp, before, after, top) of each group's last node."""
    above = tiers[-1].select("grp", "pos", "digest", "below").join(tops, "grp")
    for tier in reversed(tiers[:-1]):
        above = _descend(tier, above, ["digest", "below"], arity, height)
    return _descend(leaves, above, carried, arity, height)


def fold(leaf: Column, before: Column, after: Column) -> Column:
    """Root that follows from a leaf and its siblings, level by level."""
    steps = F.arrays_zip(before.alias("before"), after.alias("after"))
    return F.aggregate(steps, leaf, lambda got, s: F.sha2(F.concat(s["before"], got, s["after"]), 256))


def build_manifest(docs: DataFrame, fields: tuple = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source",
                   id_col: str = "doc_id", altered: dict[str, Column] | None = None, arity: int = ARITY,
                   height: int = HEIGHT) -> DataFrame:
    """Merkle tree over all rows: one subtree per group, one tree over the groups, a proof for every row.

    Rows of a group ascend by id (null ids first, repeated ids by leaf digest); runs of ``arity`` nodes
    become their digest until one is left. Groups follow in byte order, the null group first. Returns
    doc_id, leaf, seen (the leaf with the columns ``altered`` put in place), subroot, root, and the proof as
    ``before`` and ``after``: per level the digests of the siblings on either side, joined as hex text.
    ``fold`` leads from a leaf to the root. Texts may be null, empty or of any length; extra columns are
    not read; no rows give no rows.

    Blocks of ``arity ** height`` neighbours are climbed by one task each, so a group of any size is spread
    and the number of rounds grows with the logarithm of the rows to the base of a block.
    """
    told = [F.col(c) for c in fields]
    forged = [(altered or {}).get(c, F.col(c)) for c in fields]
    leaves = docs.select(
        F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string"))).alias("grp"),
        F.col(id_col).alias("doc_id"), leaf_digest(told).alias("digest"), leaf_digest(forged).alias("seen"),
        F.monotonically_increasing_id().alias("row"))
    leaves = ranked(landed(leaves, "merkle-leaves"), ["grp"], ["doc_id", "digest", "row"], "pos", "merkle-order")
    inner = _tree(leaves, "merkle-tier", arity, height)
    subroots = inner[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    subroots = ranked(subroots, ["grp"], ["name"], "pos", "merkle-groups")
    outer = _tree(subroots, "merkle-tier", arity, height)
    none = F.array().cast("array<string>")
    last = outer[-1].select("grp", none.alias("before"), none.alias("after"), F.col("digest").alias("top"))
    groups = _proven(subroots, outer, last, ["name", "digest"], arity, height)
    tops = groups.select(F.col("name").alias("grp"), "before", "after", F.concat(F.col("digest"), F.col("top")).alias("top"))
    done = _proven(leaves, inner, tops, ["doc_id", "digest", "seen"], arity, height)
    return done.select("doc_id", F.col("digest").alias("leaf"), "seen", F.substring("top", 1, 64).alias("subroot"),
                       F.substring("top", 65, 64).alias("root"), "before", "after")


def proof_digest(before: Column, after: Column) -> Column:
    """SHA-256 over all siblings, level by level, left to right."""
    joined = F.transform(F.arrays_zip(before.alias("before"), after.alias("after")), lambda s: F.concat(s["before"], s["after"]))
    return F.sha2(F.array_join(joined, ""), 256)

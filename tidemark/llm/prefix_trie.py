"""Prefix tree of conversations in double-array tries, one per shard of neighbouring prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import landed, ranked, slice_count, spread_lookup

BAND = 64  # turns of a path that one trie holds; deeper turns hang below as tries of their own
TOKEN = 40  # characters of a turn's token: half a SHA-256 as hex, then its code points
CHUNK = 1 << 16  # turns that one trie takes in
MOST_SLOTS = 1 << 23  # slots of one trie; beyond them the chunk is halved


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, i from 0, token: turns by (turn, role, text), nulls first; null role and text count as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = turns.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = told.withColumn("token", F.concat(
        F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32),
        F.lower(F.lpad(F.hex(F.length("text")), TOKEN - 32, "0"))))
    return ranked(rows, ["conv_id"], ["turn", "role", "text"], "i", "trie-turns").select("conv_id", "i", "token")


def graft(rows: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """conv_id, depth, token with each conversation's first h turns taken from its family's first conversation.

    h is the CRC-32 of the decimal conv_id modulo ``most``; a shorter or absent first conversation gives
    what it has. Each conversation also has one row without a token, so that none is lost.
    """
    convs = rows.where("i = 0").select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    first = rows.where((F.col("conv_id") % family == 0) & (F.col("i") < most - 1)).select(
        F.col("conv_id").alias("base"), F.col("i").alias("depth"), "token")
    heads = convs.join(first, "base").where("depth < h").select("conv_id", "depth", "token")
    sizes = first.groupBy("base").agg(F.count("*").alias("n"))
    short = convs.join(sizes, "base", "left").select("conv_id", (F.col("h") - F.coalesce("n", F.lit(0))).alias("gap")).where("gap > 0")
    h = F.crc32(F.col("conv_id").cast("string")) % most
    tails = spread_lookup(rows.where(F.col("i") >= h), ["conv_id"], short, "i").select(
        "conv_id", (F.col("i") - F.coalesce("gap", F.lit(0))).alias("depth"), "token")
    marks = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("token"))
    return heads.unionByName(tails).unionByName(marks)


def _shifted(root: str, band: int, seq: str) -> str:
    """Key of the node ``BAND`` turns below ``root``: position-bound digests add up, in whatever order they come."""
    said = sha256(f"{band}:{seq}".encode("ascii")).hexdigest()
    a, b = root.split("-")
    return f"{int(a) + int(said[:15], 16)}-{int(b) + int(said[15:30], 16)}"


def _child(key: str, token: str) -> str:
    return sha256((key + token).encode("ascii")).hexdigest()[:32]


def _bands(rows: DataFrame, band: int) -> DataFrame:
    """One row per conversation and ``band`` turns: the key they start from, their tokens, the code points before, the total."""
    pieces = rows.groupBy("conv_id", F.floor(F.col("depth") / band).cast("long").alias("band")).agg(
        F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("depth", "token")))).alias("turns"))
    said = pieces.select("conv_id", "band", F.col("turns.token").alias("tokens"))
    said = said.withColumn("seq", F.array_join("tokens", ""))
    digest = F.sha2(F.concat(F.col("band").cast("string"), F.lit(":"), "seq"), 256)
    number = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]
    chars = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + F.conv(F.substring(t, 33, TOKEN - 32), 16, 10).cast("long"))
    said = said.withColumns({"x": number[0], "y": number[1], "chars": chars})
    by_band = Window.partitionBy("conv_id").orderBy("band")
    earlier = by_band.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    root = F.concat_ws("-", *[F.coalesce(F.sum(c).over(earlier), zero).cast("string") for c in ("x", "y")])
    said = said.withColumns({
        "root": root, "before": F.coalesce(F.sum("chars").over(earlier), F.lit(0)),
        "total": F.sum("chars").over(Window.partitionBy("conv_id")), "last": F.lead("band").over(by_band).isNull()})
    chain = F.aggregate("tokens", F.col("root"), lambda k, t: F.substring(F.sha2(F.concat(k, t), 256), 1, 32))
    full = F.concat_ws("-", *[(F.split("root", "-")[i].cast("decimal(38,0)") + F.col(c)).cast("decimal(38,0)").cast("string") for i, c in ((0, "x"), (1, "y"))])
    end = F.when(F.size("tokens") == band, full).otherwise(chain)
    return said.select("conv_id", "band", "root", "seq", "before", "total", F.when(F.col("last"), end).alias("end"))


class TooWide(Exception):
    """A chunk whose arrays would grow beyond their bound."""


def pack(ids: np.ndarray, lens: np.ndarray, most: int = MOST_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """BASE and CHECK of the trie over rows of dense ids: the child of slot s by id t is BASE[s] + t, and CHECK there is s.

    Levels are packed one after the other. A node's children are put at the first place among the holes
    that takes them all, or behind the end; nodes with one child fill holes first. BASE may be negative.
    """
    width = int(ids.max(initial=0)) + 1
    base, check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
    check[0], size, holes = 0, 1, np.zeros(0, np.int64)
    state = np.zeros(len(ids), np.int64)

    def room(upto: int) -> None:
        nonlocal base, check
        if upto > most:
            raise TooWide
        if upto > len(check):
            grown = max(upto, 2 * len(check))
            base = np.concatenate([base, np.zeros(grown - len(base), np.int64)])
            check = np.concatenate([check, np.full(grown - len(check), -1, np.int64)])

    for j in range(ids.shape[1]):
        active = np.flatnonzero(lens > j)
        if not len(active):
            break
        pairs = np.unique(state[active] * width + ids[active, j])
        parents, kids = pairs // width, pairs % width
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        counts = np.diff(np.r_[starts, len(parents)])
        for s, k in sorted(zip(starts[counts > 1], counts[counts > 1]), key=lambda x: -x[1]):
            some = kids[s:s + k]
            near = holes[:256] - some[0]
            near = near[near + some[-1] < size]
            fits = (check[near[:, None] + some[None, :]] < 0).all(axis=1) if len(near) else np.zeros(0, bool)
            if fits.any():
                at = near[np.argmax(fits)]
            else:
                at = size - some[0]
                room(size + int(some[-1] - some[0]) + 1)
                gaps = np.setdiff1d(np.arange(size, at + some[-1]), at + some)
                holes, size = np.concatenate([holes, gaps]), int(at + some[-1]) + 1
            base[parents[s]] = at
            check[at + some] = parents[s]
            if fits.any():
                holes = holes[check[holes] < 0]
        single = starts[counts == 1]
        reused = min(len(single), len(holes))
        room(size + len(single) - reused)
        slots = np.concatenate([holes[:reused], np.arange(size, size + len(single) - reused)])
        holes, size = holes[reused:], size + len(single) - reused
        base[parents[single]] = slots - kids[single]
        check[slots] = parents[single]
        state[active] = base[state[active]] + ids[active, j]
    return base[:size], check[:size]


def walk(base: np.ndarray, check: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Level, rows still under way, their slots and the slots they came from."""
    state = np.zeros(len(ids), np.int64)
    for j in range(ids.shape[1]):
        active = np.flatnonzero(lens > j)
        if not len(active):
            return
        came = state[active]
        state[active] = base[came] + ids[active, j]
        if (check[state[active]] != came).any():
            raise ValueError("a path leaves the trie")
        yield j, active, state[active], came


def _visit(rows: pd.DataFrame, band: int, sums: list[str]) -> Iterator[pd.DataFrame]:
    """Nodes of the trie over ``rows`` with the sums of ``sums`` and the least ``first`` of the rows below them."""
    words = [[r, *[s[i:i + TOKEN] for i in range(0, len(s), TOKEN)]] for r, s in zip(rows["root"], rows["seq"])]
    lens = np.array([len(w) for w in words])
    flat = np.full((len(words), int(lens.max())), "", dtype=object)
    for i, w in enumerate(words):
        flat[i, :len(w)] = w
    # first seen first numbered, level by level: siblings get neighbouring ids
    ids = pd.factorize(flat.ravel(order="F"))[0].reshape(flat.shape, order="F")
    try:
        base, check = pack(ids, lens)
    except TooWide:
        half = len(rows) // 2
        yield from _visit(rows.iloc[:half], band, sums)
        yield from _visit(rows.iloc[half:], band, sums)
        return
    keys = np.empty(len(check), dtype=object)
    reach = np.zeros(len(check), np.int64)  # code points up to a slot
    own = {c: rows[c].to_numpy(np.int64) for c in ("band", "before", "first", *sums)}
    for j, active, slots, came in walk(base, check, ids, lens):
        nodes, at, inverse = np.unique(slots, return_index=True, return_inverse=True)
        sample = active[at]
        up = came[at]
        told = {c: np.zeros(len(nodes), np.int64) for c in sums}
        for c in sums:
            np.add.at(told[c], inverse, own[c][active])
        first = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(first, inverse, own["first"][active])
        if j == 0:
            keys[nodes] = flat[sample, 0]
            reach[nodes] = own["before"][sample]
            chars, before, parents = np.zeros(len(nodes), np.int64), reach[nodes], np.full(len(nodes), None, dtype=object)
            keep = own["band"][sample] == 0
        else:
            chars = np.array([int(t[32:], 16) for t in flat[sample, j]], np.int64)
            before = reach[up]
            reach[nodes] = before + chars
            parents = keys[up]
            if j < band:
                keys[nodes] = [_child(k, t) for k, t in zip(parents, flat[sample, j])]
            else:
                keys[nodes] = [_shifted(flat[s, 0], b, "".join(flat[s, 1:])) for s, b in zip(sample, own["band"][sample])]
            keep = np.ones(len(nodes), bool)
        out = pd.DataFrame({"key": keys[nodes], "parent": parents, "depth": own["band"][sample] * band + j, "chars": chars,
                            "before": before, "first": first, **told})
        yield out[keep]


def _merged(seqs: DataFrame, sums: list[str], band: int) -> DataFrame:
    """Nodes over all ``seqs`` (band, root, seq, before, first and ``sums``), shared upper nodes added up.

    Distinct sequences are sorted over the cluster, so a shard holds neighbouring prefixes and a prefix that
    many share spreads over shards; only nodes at shard and chunk borders come more than once.
    """
    schema = "key string, parent string, depth long, chars long, before long, first long" + "".join(f", {c} long" for c in sums)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("key", pa.string()), ("parent", pa.string()), *[(c, pa.int64()) for c in ("depth", "chars", "before", "first", *sums)]])

        def flush(waiting):
            for out in _visit(pd.concat(waiting, ignore_index=True), band, sums):
                yield pa.RecordBatch.from_pandas(out, schema=shape, preserve_index=False)

        waiting, held = [], 0
        for batch in batches:
            rows = batch.to_pandas()
            step = max(1, CHUNK // (band + 1))
            for at in range(0, len(rows), step):
                some = rows.iloc[at:at + step]
                waiting.append(some)
                held += int(some["seq"].str.len().sum()) // TOKEN + len(some)
                if held >= CHUNK:
                    yield from flush(waiting)
                    waiting, held = [], 0
        if waiting:
            yield from flush(waiting)

    parts = slice_count(seqs.sparkSession)
    dealt = seqs.repartitionByRange(parts, "root", "seq").sortWithinPartitions("root", "seq")
    return dealt.mapInArrow(nodes, schema).groupBy("key").agg(
        *[F.min(c).alias(c) for c in ("parent", "depth", "chars", "before", "first")], *[F.sum(c).alias(c) for c in sums])


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending conv_ids that end at each node; a node's ids stream by, none are held."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = ([], [])
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == key:
                    state.update(b",%d" % c)
                    continue
                if key is not None:
                    done[0].append(key)
                    done[1].append(state.hexdigest())
                key, state = k, sha256(b"%d" % c)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.string()) for d in done], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (key, state.hexdigest())], ["key", "ends_sha256"])

    dealt = ends.repartition(slice_count(ends.sparkSession), "end").sortWithinPartitions("end", "conv_id")
    return dealt.select("end", "conv_id").mapInArrow(hashes, "key string, ends_sha256 string")


def prefix_nodes(rows: DataFrame, band: int = BAND) -> DataFrame:
    """Nodes of the prefix tree over ``rows`` (conv_id, depth from 0, token; one row without token per conversation).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 per node. All are sums over the conversations through a node, so no walk up the tree is needed:
    a node belongs to its smallest member, whose nodes are a tail of its path. The text below a node, each
    node once, is then what its members own, and what it saves is their text less that.
    """
    bands = landed(_bands(rows, band), "trie-bands")
    seqs = landed(bands.groupBy("band", "root", "seq").agg(
        F.min("before").alias("before"), F.min("conv_id").alias("first"), F.count("*").alias("n_convs"), F.sum("total").alias("total")), "trie-seqs")
    nodes = _merged(seqs, ["n_convs", "total"], band)
    nodes = landed(nodes, "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = landed(nodes.join(children, "key", "left").fillna(0, ["n_children"]), "trie-nodes")
    owned = nodes.groupBy(F.col("first").alias("conv_id")).agg(
        F.sum("chars").alias("owned"), F.sum((F.col("n_children") == 0).cast("long")).alias("n_leaves"))
    weights = bands.where("band = 0").select("conv_id", "total").join(owned, "conv_id", "left").fillna(0, ["owned", "n_leaves"])
    weights = landed(weights, "trie-weights")
    weighed = spread_lookup(bands, ["conv_id"], weights.drop("total"), "band").groupBy("band", "root", "seq").agg(
        F.min("before").alias("before"), F.min("conv_id").alias("first"), F.sum("owned").alias("owned"), F.sum("n_leaves").alias("n_leaves"))
    below = _merged(landed(weighed, "trie-weighed"), ["owned", "n_leaves"], band).select("key", "owned", "n_leaves")
    whole = nodes.join(below, "key").join(_hashed_ends(bands.where("end is not null").select("end", "conv_id")), "key", "left")
    whole = spread_lookup(whole, ["first"], weights.select(F.col("conv_id").alias("first"), F.col("total").alias("own_total"), F.col("owned").alias("own")), "key")
    whole = spread_lookup(whole, ["parent"], nodes.select(F.col("key").alias("parent"), F.col("first").alias("parent_conv_id")), "key")
    text: Column = F.col("total") - F.col("n_convs") * F.col("before")
    distinct: Column = F.col("owned") - F.col("own") + F.col("own_total") - F.col("before")
    return whole.select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (text - distinct).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, band: int = BAND) -> DataFrame:
    """Prefix tree of the grafted conversations; see ``graft`` and ``prefix_nodes``.

    Null turns come first, ties go by role, then text; repeated rows are turns of their own. Null role or
    text is empty. Rows without conv_id belong to no conversation. Extra columns are not read; no rows give
    no nodes. A conversation of any length is cut into bands, a prefix that many share is spread over shards.
    """
    return prefix_nodes(graft(ordered_turns(turns)), band)

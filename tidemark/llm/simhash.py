"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import landed, spread_lookup, without_rows
from tidemark.session import cut_lineage, unsized

BITS = 64
PACK = 1024  # distinct fingerprints that one task compares with each other


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles; 0 where there are no words.

    ``bytes.split`` and ``bytes.lower`` know exactly the white space and the letters of the contract.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digests = np.frombuffer(b"".join([xxhash.xxh64_digest(g, 42) for g in grams]), dtype=np.uint8)
    n = len(digests) // 8
    ones = np.zeros(BITS, dtype=np.int64)
    step = 255 * 512  # bits of 255 digests add up in a byte; blocks bound the memory for long texts
    for at in range(0, n, step):
        bits = np.unpackbits(digests[8 * at:8 * (at + step)]).reshape(-1, BITS)
        full = len(bits) // 255 * 255
        if full:
            ones += np.add.reduce(bits[:full].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += np.add.reduce(bits[full:], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def cover_masks(radius: int) -> list[int]:
    """Masks of the covering family: any two words within ``radius`` bits agree under one of them.

    Each bit i gets a non-zero vector m(i) of radius + 1 bits, spread evenly. Mask v holds the bits whose
    m(i) has odd product with v. The vectors of at most ``radius`` differing bits span less than the whole
    space, so some v is orthogonal to all of them, and mask v leaves these bits out.
    """
    vectors = 2 ** (radius + 1) - 1
    m = [1 + i * vectors // BITS % vectors if vectors < BITS else 1 + i for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if bin(m[i] & v).count("1") % 2) for v in range(1, vectors + 1)]


def _forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``prints``: at most one per fingerprint."""
    left = np.arange(len(prints))
    edges = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[i]) <= radius
            for j in left[near]:
                edges.append((i, j))
                queue.append(j)
            left = left[~near]
    return edges


def _bucket_edges(radius: int):
    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [], []
            for prints in batch["prints"]:
                own = np.asarray(prints, dtype=np.int64)
                words = own.view(np.uint64)
                for i, j in _forest(words, radius):
                    a.append(own[i])
                    b.append(own[j])
            yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})
    return edges


def _ball_keys(radius: int, masks: list[int]):
    """Split points of a crowded bucket: words within half the radius of a member, over the free bits only."""
    near = radius // 2
    far = radius - near

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips = {}
        for t, mask in enumerate(masks):
            free = [np.uint64(1 << i) for i in range(BITS) if not mask >> i & 1]
            level = [(np.uint64(0), -1)]
            rows = [(np.uint64(0), 0)]
            for d in range(1, far + 1):
                level = [(w | free[j], j) for w, last in level for j in range(last + 1, len(free))]
                rows += [(w, d) for w, _ in level]
            flips[t] = (np.array([w for w, _ in rows], dtype=np.uint64), np.array([d <= near for _, d in rows]))
        for batch in batches:
            for t, own in batch.groupby("t"):
                words, close = flips[t]
                prints = own["fp"].to_numpy(dtype=np.int64)
                for at in range(0, len(prints), 64):
                    some = prints[at:at + 64]
                    points = (some.view(np.uint64)[:, None] ^ words[None, :]).view(np.int64)
                    yield pd.DataFrame({
                        "point": points.ravel(), "fp": np.repeat(some, len(words)), "close": np.tile(close, len(some))})
    return keys


def links(prints: DataFrame, radius: int = 3, pack: int = PACK) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` linked at ``radius`` bits or fewer.

    Fingerprints meet in the buckets of the covering tables. A bucket of up to ``pack`` is compared in one
    task, which returns a spanning forest, not its pairs. Members of larger buckets meet at points: two
    words within the radius share a point within half of it (rounded down) of one and the rest of the
    other. All within half are linked with each other, so a point needs one edge per member. The rows of
    all tables are some thirty times what the planner guesses of them, so the joins go by measured sizes.
    """
    masks = cover_masks(radius)
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("mask")) for t, m in enumerate(masks)]))
    dealt = unsized(prints.select("fp")).select("fp", table.alias("x")).select("fp", "x.t", F.col("fp").bitwiseAND(F.col("x.mask")).alias("bucket"))
    sizes = dealt.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(spread_lookup(dealt, ["t", "bucket"], sizes, "fp").where("n > 1"))
    small = members.where(F.col("n") <= pack).groupBy("t", "bucket").agg(F.collect_list("fp").alias("prints"))
    edges = small.select("prints").mapInPandas(_bucket_edges(radius), "a long, b long")
    crowd = members.where(F.col("n") > pack).select("t", "fp")
    points = crowd.mapInPandas(_ball_keys(radius, masks), "point long, fp long, close boolean")
    heads = points.where("close").groupBy("point").agg(F.min("fp").alias("a"))
    star = spread_lookup(points, ["point"], heads, "fp").where("a <> fp")
    return edges.unionByName(star.select("a", F.col("fp").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating rounds: neighbours above a node hook onto its smallest neighbour, then those below do,
    until nothing changes; the number of rounds grows with the logarithm of the longest path.
    """
    state = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_lookup(both, ["u"], least, "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_lookup(large, ["u"], low, "v")
        hooked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        state = cut_lineage(hooked.where("u <> v").distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def fingerprint_column(shingle: int):
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([_signed(fingerprint(t, shingle)) for t in texts], dtype=np.int64))
    return prints


def _grouped(prints: DataFrame, radius: int, pack: int) -> DataFrame:
    """``prints`` (row, doc_id, fp) with the smallest doc_id of each row's component."""
    prints = unsized(prints)  # a file's size tells little of its rows: the looked-up prints are not broadcast by it
    firsts = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp"), radius, pack))
    grouped = cut_lineage(firsts.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = spread_lookup(grouped, ["root"], smallest, "fp").select("fp", "root", "component_id")
    return spread_lookup(prints, ["fp"], named, "row")


def near_groups(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text",
                pack: int = PACK) -> DataFrame:
    """SimHash fingerprint and component of every row: row, doc_id, fp, component_id.

    component_id is the smallest doc_id reachable over links of ``radius`` differing bits or fewer. Null and
    empty texts have fingerprint zero and are linked like any other. Repeated rows share their component;
    a null id has no say in a component unless all its ids are null. Extra columns are not read; no rows
    give no rows.
    """
    prints = landed(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        fingerprint_column(shingle)(F.col(text_col)).alias("fp")), "simhash")
    return _grouped(prints, radius, pack).select("row", "doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text",
                     pack: int = PACK) -> DataFrame:
    """One row of each component stays, that with the smallest id; all columns as they came.

    Null ids stay only where a component has no other, of equal ids the first row. Null and empty texts
    are near copies of each other; no rows give no rows.
    """
    rows = landed(docs.select(
        F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"),
        fingerprint_column(shingle)(F.col(text_col)).alias("fp")), "simhash-docs")
    grouped = cut_lineage(_grouped(rows.select("row", F.col(f"doc.{id_col}").alias("doc_id"), "fp"), radius, pack).select("row", "doc_id", "root"))
    stays = grouped.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("stay")).select("root", F.col("stay.row").alias("kept"))
    gone = spread_lookup(grouped.select("root", "row"), ["root"], stays, "row").where("row <> kept").select("row")
    return without_rows(rows, F.col("row"), gone).select("doc.*")

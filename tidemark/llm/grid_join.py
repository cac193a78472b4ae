"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import landed, ranked, slice_count, spread_lookup
from tidemark.llm.simhash import components

AXES = 8  # leading principal dimensions whose cells give the order
SAMPLE = 2048  # distinct vectors that the principal dimensions are fitted on; any basis gives the same links
LEAF = 128  # vectors that are compared with each other as one matrix product
FAN = 8  # intervals of one level in an interval of the next
SLACK = 1e-9  # rounding of bounds, and distance from the threshold within which a cosine is computed again


def _packed(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """row, vec_id, label, dim, vec (bytes); vec is null for vectors that link with nothing."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vec_col).cast("array<double>").alias("vec"))
    usable = (F.col("label").isNotNull() & (F.size("vec") > 0)
              & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
              & F.exists("vec", lambda x: x != 0))
    # scaled by its largest part, no vector overflows or vanishes when squared
    largest = F.array_max(F.transform("vec", F.abs))
    rows = rows.withColumn("vec", F.when(usable, F.when(largest.between(1e-100, 1e100), F.col("vec"))
                                         .otherwise(F.transform("vec", lambda x: x / largest))))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(3)
            values, at = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
            there = vec.is_valid().to_pylist()
            packed = [values[at[i]:at[i + 1]].tobytes() if there[i] else None for i in range(len(vec))]
            dims = [int(at[i + 1] - at[i]) if there[i] else 0 for i in range(len(vec))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dims, pa.int32()), pa.array(packed, pa.binary())],
                                             ["row", "vec_id", "label", "dim", "vec"])

    return rows.mapInArrow(pack, f"row long, vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, vec binary")


def _units(packed, dim: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(packed), dtype=np.float64).reshape(-1, dim)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def principal(classes: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Orthonormal axes by length of vector, strongest first, from at most ``sample`` distinct vectors."""
    some = classes.select("dim", "vec").orderBy(F.xxhash64("vec"), "vec").limit(sample).toPandas()
    axes = {}
    for dim, own in some.groupby("dim"):
        units = _units(own["vec"], int(dim))
        _values, found = np.linalg.eigh(units.T @ units)
        axes[int(dim)] = np.ascontiguousarray(found[:, ::-1])
    return axes


def _turned(units: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    basis = axes.get(units.shape[1])
    return units if basis is None else units @ basis


def _with_cells(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Grid cell of each vector on the leading axes: cells of width ``eps``, so links join neighbouring cells only."""
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["dim", "vec"]).to_pandas()
            found = np.empty(len(rows), dtype=object)
            for dim, at in rows.groupby("dim").indices.items():
                grid = np.floor(_turned(_units(rows["vec"].iloc[at], int(dim)), axes)[:, :AXES] / eps).astype(np.int32)
                for i, own in zip(at, grid):
                    found[i] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int32()))], [*batch.schema.names, "cell"])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return classes.mapInArrow(cells, StructType([*classes.schema.fields, StructField("cell", ArrayType(IntegerType()))]))


def _boxes(rows: DataFrame, axes: dict[int, np.ndarray], label_kind: str) -> DataFrame:
    """Bounds of each block's vectors on all axes."""
    def bounds(key, block):
        spots = _turned(_units(block["vec"], int(key[1])), axes)
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "at": [key[2]], "lo": [spots.min(axis=0)], "hi": [spots.max(axis=0)]})

    return rows.select("label", "dim", "block", "vec").groupBy("label", "dim", "block").applyInPandas(
        bounds, f"label {label_kind}, dim int, at long, lo array<double>, hi array<double>")


def _above(boxes: DataFrame) -> DataFrame:
    """Bounds of intervals of ``FAN`` neighbours."""
    def folded(column, pick):
        return F.aggregate(F.col(column), F.element_at(column, 1), lambda a, x: F.zip_with(a, x, pick))

    met = boxes.groupBy("label", "dim", F.floor(F.col("at") / FAN).cast("long").alias("at")).agg(
        F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    return met.select("label", "dim", "at", folded("lo", lambda x, y: F.least(x, y)).alias("lo"), folded("hi", lambda x, y: F.greatest(x, y)).alias("hi"))


def _gap(lo_a: str, hi_a: str, lo_b: str, hi_b: str) -> Column:
    """Squared distance of two boxes."""
    apart = F.zip_with(F.zip_with(F.col(lo_b), F.col(hi_a), lambda x, y: x - y), F.zip_with(F.col(lo_a), F.col(hi_b), lambda x, y: x - y),
                       lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda a, g: a + g * g)


def near_blocks(boxes: DataFrame, eps: float) -> DataFrame:
    """Pairs (label, dim, a, b), a <= b, of blocks that may hold a link.

    Starts with each label's whole sequence against itself; each round cuts both intervals of a pair in
    ``FAN`` and goes on with the pairs whose bounds are within ``eps``.
    """
    levels = [boxes]
    while levels[-1].where("at > 0").head(1):
        levels.append(landed(_above(levels[-1]), "grid-level"))
    pairs = levels[-1].select("label", "dim", F.col("at").alias("a"), F.col("at").alias("b"))
    for level in reversed(levels[:-1]):
        cut = pairs.select("label", "dim", "b", F.explode(F.sequence(F.col("a") * FAN, F.col("a") * FAN + FAN - 1)).alias("a"))
        sides = [level.select("label", "dim", F.col("at").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}")) for s in "ab"]
        cut = cut.join(sides[0], ["label", "dim", "a"])
        cut = cut.withColumn("b", F.explode(F.sequence(F.col("b") * FAN, F.col("b") * FAN + FAN - 1))).where("a <= b")
        cut = cut.join(sides[1], ["label", "dim", "b"]).where(_gap("lo_a", "hi_a", "lo_b", "hi_b") <= eps * eps + SLACK)
        pairs = landed(cut.select("label", "dim", "a", "b"), "grid-pairs")
    return pairs


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what ``linked`` connects, fewer than rows and columns."""
    edges = []
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    while rows.any():
        start = int(np.argmax(rows))
        rows[start] = False
        queue = [start]
        while queue:
            r = queue.pop()
            for c in np.flatnonzero(linked[r] & cols):
                edges.append((r, int(c)))
                cols[c] = False
                for other in np.flatnonzero(linked[:, c] & rows):
                    edges.append((int(other), int(c)))
                    rows[other] = False
                    queue.append(int(other))
    return edges


class _Merged:
    """Union of local edges; keeps those that join two parts."""

    def __init__(self, n: int):
        self.up, self.kept = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def add(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[a] = b
            self.kept.append((i, j))


def join_sequences(a: np.ndarray, b: np.ndarray | None, weight_a: np.ndarray, weight_b: np.ndarray | None, spots_a: np.ndarray,
                   spots_b: np.ndarray | None, threshold: float, exact_a=None, exact_b=None, leaf: int = LEAF):
    """Links per vector (by weight) and connecting edges between two grid-ordered runs of units, or inside one (b None).

    Intervals are halved until both are short; pairs whose bounds are too far apart are left out. Vectors of
    b are numbered behind those of a in the edges.
    """
    one = b is None
    if one:
        b, weight_b, spots_b, exact_b = a, weight_a, spots_a, exact_a
    exact_a = a if exact_a is None else exact_a
    exact_b = b if exact_b is None else exact_b
    limit = 2 - 2 * threshold + SLACK
    n_a, n_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    merged, shift = _Merged(len(a) if one else len(a) + len(b)), 0 if one else len(a)
    bounds = [[(s[i:i + leaf].min(axis=0), s[i:i + leaf].max(axis=0)) for i in range(0, len(s), leaf)] for s in (spots_a, spots_b)]
    stacked = [(np.array([x[0] for x in side]), np.array([x[1] for x in side])) for side in bounds]

    def distant(i0: int, i1: int, j0: int, j1: int) -> bool:
        (la, ha), (lb, hb) = stacked
        lo_a, hi_a = la[i0:i1].min(axis=0), ha[i0:i1].max(axis=0)
        lo_b, hi_b = lb[j0:j1].min(axis=0), hb[j0:j1].max(axis=0)
        gap = np.maximum(np.maximum(lo_b - hi_a, lo_a - hi_b), 0)
        return float(gap @ gap) > limit

    work = [(0, len(bounds[0]), 0, len(bounds[1]))]
    while work:
        i0, i1, j0, j1 = work.pop()
        if (one and i0 >= j1) or distant(i0, i1, j0, j1):
            continue
        if i1 - i0 > 1 or j1 - j0 > 1:
            im, jm = (i0 + i1 + 1) // 2, (j0 + j1 + 1) // 2
            left = [(i0, im), (im, i1)] if i1 - i0 > 1 else [(i0, i1)]
            right = [(j0, jm), (jm, j1)] if j1 - j0 > 1 else [(j0, j1)]
            work += [(*x, *y) for x in left for y in right]
            continue
        if one and i0 > j0:
            continue
        ra, rb = slice(i0 * leaf, i1 * leaf), slice(j0 * leaf, j1 * leaf)
        close = a[ra] @ b[rb].T
        linked = close >= threshold
        for x, y in np.argwhere(np.abs(close - threshold) < SLACK):
            linked[x, y] = _exact(exact_a[ra][x], exact_b[rb][y]) >= threshold
        if not linked.any():
            continue
        n_a[ra] += linked @ weight_b[rb]
        if not (one and i0 == j0):
            target = n_a if one else n_b
            target[rb] += linked.T @ weight_a[ra]
        for x, y in _forest(linked):
            merged.add(x + i0 * leaf, y + j0 * leaf + shift)
    return n_a, n_b, merged.kept


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def compare(key, rows):
        dim = int(key[1])
        sides = []
        for side in (0, 1):
            own = rows[rows["side"] == side].sort_values("pos")
            if not len(own):
                continue
            units = _units(own["vec"], dim)
            raw = np.frombuffer(b"".join(own["vec"]), dtype=np.float64).reshape(-1, dim)
            sides.append((units, own["mult"].to_numpy(np.int64), _turned(units, axes), raw, own["cls"].to_numpy(np.int64)))
        first, second = sides[0], sides[1] if len(sides) > 1 else (None,) * 5
        n_a, n_b, kept = join_sequences(first[0], second[0], first[1], second[1], first[2], second[2], threshold, first[3], second[3])
        names, counts = (first[4], n_a) if second[0] is None else (np.concatenate([first[4], second[4]]), np.concatenate([n_a, n_b]))
        some = counts > 0
        ends = np.array(kept, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"x": np.concatenate([names[some], names[ends[:, 0]]]), "y": np.concatenate([counts[some], names[ends[:, 1]]]),
                             "edge": np.concatenate([np.zeros(some.sum(), bool), np.ones(len(ends), bool)])})
    return compare


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label", block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; links have equal labels and a cosine of ``threshold`` or more.

    Vectors that are null, empty, zero or hold null or non-finite parts, or whose label is null, link with
    nothing; so do vectors of different lengths. Repeated rows are vectors of their own. component_id is the
    smallest vec_id reachable, itself included; null ids have no say unless all ids are null, and are not
    kept. Ties at the threshold are settled by exact sums. Extra columns are not read; no rows give no rows.

    Equal vectors travel as one with a count. Units are sorted by the cells they fall in on the leading
    principal dimensions, and the sequence is cut in blocks; pairs of intervals are cut further until only
    pairs of blocks are left that can hold a link. These are compared in tasks of two blocks, which return
    counts and a spanning forest, never the pairs.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    eps = math.sqrt(2 - 2 * threshold)
    rows = landed(_packed(vectors, id_col, vec_col, label_col).withColumn("key", F.sha2("vec", 256)), "grid-rows")
    label_kind = rows.schema["label"].dataType.simpleString()
    classes = landed(rows.where("vec is not null").groupBy("label", "dim", "vec").agg(
        F.min("row").alias("cls"), F.count("*").alias("mult"), F.min("vec_id").alias("first")), "grid-classes")
    axes = principal(classes)
    inner = classes.select("label", "dim", "vec", "cls", "mult")
    sized = F.greatest(F.lit(LEAF), F.least(F.lit(block), F.floor(F.lit(block * 64) / F.col("dim"))))
    sorted_ = ranked(_with_cells(inner, axes, eps), ["label", "dim"], ["cell", "cls"], "pos", "grid-order").withColumn(
        "block", F.floor(F.col("pos") / sized).cast("long")).drop("cell")
    boxes = landed(_boxes(sorted_, axes, label_kind), "grid-boxes")
    pairs = near_blocks(boxes, eps)
    left = sorted_.join(pairs.withColumn("block", F.col("a")), ["label", "dim", "block"]).withColumn("side", F.lit(0))
    right = sorted_.join(pairs.where("a < b").withColumn("block", F.col("b")), ["label", "dim", "block"]).withColumn("side", F.lit(1))
    met = left.unionByName(right).repartition(slice_count(rows.sparkSession), "label", "dim", "a", "b")
    found = landed(met.groupBy("label", "dim", "a", "b").applyInPandas(_compare(axes, threshold), "x long, y long, edge boolean"), "grid-links")
    counts = found.where("not edge").groupBy(F.col("x").alias("cls")).agg(F.sum("y").alias("n"))
    edges = found.where("edge").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = components(edges).select(F.col("node").alias("cls"), "root")
    named = classes.select("label", F.sha2("vec", 256).alias("key"), "cls", "first").join(roots, "cls", "left").join(counts, "cls", "left")
    named = landed(named.withColumn("root", F.coalesce("root", "cls")), "grid-named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    told = spread_lookup(named, ["root"], least, "cls").select("label", "key", "component_id", (F.col("n") - 1).alias("n_links"))
    whole = spread_lookup(rows.select("row", "vec_id", "label", "key"), ["label", "key"], told, "row")
    root = F.coalesce("component_id", "vec_id")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"),
                        F.coalesce(F.col("vec_id") == root, F.lit(False)).alias("kept"))

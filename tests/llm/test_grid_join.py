"""Grid order join against all pairs."""

import math

import numpy as np
import pytest

from tidemark.llm import grid_join as G


def plain(vectors, threshold):
    n = len(vectors)
    fine = [l is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _i, v, l in vectors]
    near = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if fine[i] and fine[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    out, seen = [], {}
    for i in range(n):
        if i not in seen:
            part, queue = {i}, [i]
            while queue:
                for j in near[queue.pop()] - part:
                    part.add(j)
                    queue.append(j)
            ids = [vectors[j][0] for j in part if vectors[j][0] is not None]
            seen.update(dict.fromkeys(part, min(ids) if ids else None))
        out.append((vectors[i][0], len(near[i]), seen[i], vectors[i][0] is not None and vectors[i][0] == seen[i]))
    return sorted(out, key=str)


def vectors(seed, n=700, dim=12):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if i % 3 == 0 or i < 20:
            v = rng.normal(size=dim)
        else:
            v = np.array(out[rng.integers(0, 20)][1]) + rng.normal(size=dim) * rng.choice([0, 0.05, 0.12])
        out.append((i, [float(x) for x in v], int(i % 10 == 1)))
    out += [(2000 + i, [x * 3 for x in out[i][1]], 0) for i in range(5)]  # scaled copies
    out += [(7, out[7][1], 0), (7, out[7][1], 0), (None, out[7][1], 0), (None, [0.0] * 11 + [9.0], 0)]
    out += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * dim, 0), (3003, [None] * dim, 0), (3004, [float("nan")] * dim, 0),
            (3005, [float("inf")] * dim, 0), (3006, out[0][1], None), (3007, [1.0, 0.0], 0), (3008, [1.0, 0.001], 0), (3009, [1e300] * dim, 0), (3010, [1e-300] * dim, 0)]
    return out


@pytest.mark.parametrize("seed, leaf", [(1, 128), (2, 16)])
def test_links_equal_all_pairs(spark, monkeypatch, seed, leaf):
    monkeypatch.setattr(G, "LEAF", leaf)
    data = vectors(seed)
    df = spark.createDataFrame([(*v, 1, 2) for v in data], "vec_id long, embedding array<double>, label int, cls int, block int")
    got = G.near_vectors(df, block=leaf)
    assert sorted(map(tuple, got.collect()), key=str) == plain(data, 0.98)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert G.near_vectors(df).collect() == []


def test_far_intervals_are_skipped():
    """Two distant bundles: no product is taken between them."""
    rng = np.random.default_rng(0)
    a = np.r_[np.eye(8)[:1].repeat(64, 0), -np.eye(8)[:1].repeat(64, 0)] + rng.normal(size=(128, 8)) * 1e-3
    a /= np.linalg.norm(a, axis=1)[:, None]
    ones = np.ones(128, np.int64)

    class Counted(np.ndarray):
        products = 0

        def __matmul__(self, other):
            Counted.products += 1
            return np.asarray(self) @ np.asarray(other)

    links, _same, kept = G.join_sequences(a.view(Counted), None, ones, None, a, None, 0.98, leaf=64)
    assert (links == 64).all() and len(kept) == 126 and Counted.products == 2


def test_leaves_of_a_long_chain(spark):
    """A chain of small turns is one component though its ends are far apart."""
    step = math.acos(0.981)
    data = [(i, [math.cos(i * step), math.sin(i * step)], 1) for i in range(25)]
    got = G.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.n_links for r in got) == 2 * 24

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.simhash import components, cover_masks, drop_near_copies, fingerprint, links, near_groups


def linked(prints, radius=3):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(prints, 2):
        if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= radius:
            parent[find(a)] = find(b)
    groups = {}
    for p in prints:
        groups.setdefault(find(p), set()).add(p)
    return sorted(map(sorted, groups.values()))


def test_masks_cover_every_pair_within_the_radius():
    masks = cover_masks(3)
    assert len(masks) == 15 and all(28 <= bin(m).count("1") <= 36 for m in masks)
    rng = random.Random(1)
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(flip & m == 0 for m in masks)


@pytest.mark.parametrize("pack", (1024, 2))
def test_links_connect_what_brute_force_connects(spark, pack):
    rng = random.Random(pack)
    prints = set()
    for _ in range(12):
        word = rng.getrandbits(64)
        for _ in range(9):
            prints.add(word - (1 << 64) if word >> 63 else word)
            word ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    root = {r.node: r.root for r in components(links(df, 3, pack)).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(root.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == linked(sorted(prints))


def test_long_chain_has_one_root(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 7), (200, 201)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in [*range(1, 61), 100]) and got[201] == 200


def test_fingerprints_by_definition(docs):
    import re
    import xxhash

    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(up))
        grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert fingerprint(r.text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components_of_edge_cases(docs, no_docs):
    rows = near_groups(docs).collect()
    assert len(rows) == docs.count()
    by_text = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_text[0].fp == by_text[1].fp == by_text[2].fp == 0 and by_text[2].component_id == 0
    assert by_text[9].component_id == by_text[10].component_id == 9
    left = drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == len({r.component_id for r in rows})
    assert near_groups(no_docs).count() == 0 and drop_near_copies(no_docs).count() == 0


@pytest.fixture
def threshold(spark):
    """A broadcast threshold between what the planner guesses of the tables and what they hold."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, size)
    spark.conf.set(key, before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_tables_are_not_broadcast_by_a_guess(spark, threshold, monkeypatch):
    plans = []

    def cut(df, inner=simhash.cut_lineage):
        out = inner(df)
        plans.append(plan_of(df))
        return out

    monkeypatch.setattr(simhash, "cut_lineage", cut)
    threshold("100k")  # the planner guesses 16 to 32 KB; the 30,000 rows of all tables hold 960 KB
    words = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    pairs = spark.range(1000).select(F.xxhash64("id").bitwiseXOR(F.lit(1)).alias("fp"))
    found = {frozenset(r) for r in links(words.unionByName(pairs)).collect()}
    assert len(found) == 1000 and all((a ^ b) == 1 for a, b in found)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_prints_are_not_broadcast_by_the_size_of_their_file(spark, threshold):
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(str(k))), 256) for k in range(3)]).alias("text"))
    threshold("300k")  # the file of three columns has some 320 KB, so the planner guesses 200 KB of two; they hold 480 KB
    out = near_groups(docs)
    rows = out.collect()
    assert len(rows) == n and all(r.component_id == r.doc_id for r in rows)
    assert "BroadcastHashJoin" not in plan_of(out)

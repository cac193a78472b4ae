"""Merkle manifest against a plain tree."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle as M


def h(text):
    return sha256(text.encode("utf-8")).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level, arity):
    levels = [level]
    while len(level) > 1:
        level = [h("".join(level[i:i + arity])) for i in range(0, len(level), arity)]
        levels.append(level)
    return levels


def siblings(levels, at, arity):
    out = []
    for level in levels[:-1]:
        run = level[at // arity * arity:at // arity * arity + arity]
        out.append(("".join(run[:at % arity]), "".join(run[at % arity + 1:])))
        at //= arity
    return out


def plain(rows, arity):
    """(doc_id, leaf, subroot, root, proof, folded root of the lower-cased text) per row."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], plain_leaf(r), plain_leaf((*r[:4], r[4] and r[4].lower()))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: climb([x[1] for x in by[s]], arity) for s in order}
    outer = climb([trees[s][-1][0] for s in order], arity)
    out = []
    for g, s in enumerate(order):
        for at, (doc, leaf, seen) in enumerate(by[s]):
            proof = siblings(trees[s], at, arity) + siblings(outer, g, arity)
            got = seen
            for before, after in proof:
                got = h(before + got + after)
            out.append((doc, leaf, trees[s][-1][0], outer[-1][0], h("".join(b + a for b, a in proof)), got))
    return out


def rows():
    data = [(i, f"s{i % 4}" if i % 5 else None, "en" if i % 3 else None, i * 7, None if i % 11 == 0 else "" if i % 7 == 0 else f"Täxt {i} " * (i % 6)) for i in range(70)]
    data += [(3, "hot", "de", 1, "Same"), (3, "hot", "de", 1, "Same"), (3, "hot", "de", None, "Other"), (None, "hot", None, None, None)]
    data += [(1000 + i, "hot", "en", i, "w" * i) for i in range(90)]
    data += [(5000, "alone", "en", 1, "x" * 20000), (5001, "", "en", 0, "")]
    return data


@pytest.mark.parametrize("arity, height", [(16, 3), (2, 2), (3, 1)])
def test_tree_equals_plain(spark, arity, height):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows()], "doc_id long, source string, lang string, n_chars long, text string, grp int, pos int")
    made = M.build_manifest(df, altered={"text": F.lower("text")}, arity=arity, height=height)
    got = made.select("doc_id", "leaf", "subroot", "root", M.proof_digest(F.col("before"), F.col("after")),
                      M.fold(F.col("seen"), F.col("before"), F.col("after"))).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows(), arity), key=key)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert M.build_manifest(df).collect() == []


def test_queue_stays_short():
    """Children come before parents, and fewer than arity messages per level wait."""
    digests = [h(str(i)) for i in range(4096)]
    most = 0
    push = M.heapq.heappush

    def counting(queue, item):
        nonlocal most
        push(queue, item)
        most = max(most, len(queue))

    M.heapq.heappush = counting
    try:
        top, kids = M.forward(digests, 3)
    finally:
        M.heapq.heappush = push
    assert top == climb(digests, 16)[-1][0] and most <= 16 * 3
    assert len(M.backward(4096, kids, 3, ([], []))) == 4096

"""Prefix tree against plain counting, and the arrays on their own."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import prefix_trie as P


def plain(turns):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, said in own.items():
        n = crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(np.fmod(c, 100)), [])[:n] + said[n:]
    nodes, ends = {}, {}
    for c, said in built.items():
        for d in range(len(said) + 1):
            nodes.setdefault(tuple(said[:d]), []).append(c)
        ends.setdefault(tuple(said), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(members) - 1) * (len(path[-1][1]) if path else 0)
    return sorted((min(m), len(p), -1 if not p else min(nodes[p[:-1]]), len(m), kids.get(p, 0), leaves[p], saved[p],
                   sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in nodes.items())


def talks(seed):
    rng = random.Random(seed)
    words = ["hi", "Grüße 漢字", "", None, "ok", "a longer answer " * 40]
    out = []
    for c in [*range(40), 100, 101, 205, 299, -3, -100, 7_000_000_000_123]:
        hot = c % 3 == 0
        for turn in range(rng.randrange(1, 12) if c != 100 else 150):
            out.append((c, turn if turn else None, "user" if turn % 2 else None, words[4] if hot and turn < 8 else rng.choice(words)))
    out += [(c, t, r, x) for c, t, r, x in out if c == 5]  # repeated rows
    return out + [(None, 1, "user", "lost"), (None, None, None, None)]


@pytest.mark.parametrize("band, chunk", [(64, 1 << 16), (3, 20)])
def test_tree_equals_plain(spark, monkeypatch, band, chunk):
    monkeypatch.setattr(P, "CHUNK", chunk)
    turns = talks(band)
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, i int, token string")
    got = P.conversation_trie(df, band)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    rows = sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in got.collect())
    assert rows == plain(turns)


def test_no_turns(spark):
    assert P.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_arrays_hold_exactly_the_paths(seed):
    rng = np.random.default_rng(seed)
    lens = rng.integers(1, 9, 300)
    ids = rng.integers(0, 40 if seed % 2 else 4, (300, 8)).astype(np.int64)
    base, check = P.pack(ids, lens)
    slots = {}
    for j, rows, now, came in P.walk(base, check, ids, lens):
        for r, slot in zip(rows, now):
            slots.setdefault(slot, set()).add(tuple(ids[r, :j + 1]))
    assert all(len(paths) == 1 for paths in slots.values())
    assert len(slots) == len({tuple(ids[r, :j + 1]) for r in range(300) for j in range(lens[r])}) == (check >= 0).sum() - 1


def test_wide_chunks_are_halved(monkeypatch):
    import pandas as pd

    rows = pd.DataFrame({"root": "0-0", "seq": [f"{i:032x}00000001" * 2 for i in range(64)], "band": 0, "before": 0, "first": range(64), "n": 1})
    whole = pd.concat(P._visit(rows, 64, ["n"])).groupby("key")[["n"]].sum()
    pack, calls = P.pack, []

    def small(ids, lens):
        calls.append(len(ids))
        return pack(ids, lens, most=40)

    monkeypatch.setattr(P, "pack", small)
    parts = pd.concat(P._visit(rows, 64, ["n"])).groupby("key")[["n"]].sum()
    assert len(calls) > 1 and parts.equals(whole)

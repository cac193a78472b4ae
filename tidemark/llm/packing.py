"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import landed
from tidemark.session import cut_lineage

END_ID = 2
MOST_OFFSETS = 1_000_000  # (task, length) counts up to this number are broadcast; more are joined by shuffle
_ENCODERS: dict[str, object] = {}


def added_tokens(tokenizer: str) -> list[dict]:
    """The entries of ``added_tokens``; the vocabulary around them is not parsed, to save memory."""
    with open(tokenizer, encoding="utf-8") as file:
        text = file.read()
    key = '"added_tokens":'
    at = text.find(key)
    return json.JSONDecoder().raw_decode(text[at + len(key):at + len(key) + 100_000].lstrip())[0] if at >= 0 else []


def encoder(tokenizer: str):
    """One encoder per worker process for the byte-level vocabulary file ``tokenizer`` (.json).

    The ranks of the same vocabulary beside it (.tiktoken) encode five times as fast with equal ids. What
    that library refuses, the reference library encodes. Added tokens such as ``<|endoftext|>`` have their
    own id wherever a text spells them, as in the reference library.
    """
    if tokenizer not in _ENCODERS:
        import os

        fast, slow = None, []
        ranks = tokenizer.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            added = added_tokens(tokenizer)
            # such options (blanks taken in, whole words only) are known to the reference library alone
            if not any(t.get(o) for t in added for o in ("single_word", "lstrip", "rstrip", "normalized")):
                with open(ranks, "rb") as lines:
                    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
                fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                         special_tokens={t["content"]: t["id"] for t in added})

        def encode(text: str) -> list[int]:
            if fast is not None:
                try:
                    return fast.encode(text, allowed_special="all")
                except Exception:  # noqa: BLE001 - the library gives up on some very long runs
                    pass
            if not slow:  # loaded only where it is needed, to save memory
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(tokenizer))
            return slow[0].encode(text, add_special_tokens=False).ids

        _ENCODERS[tokenizer] = encode
    return _ENCODERS[tokenizer]


def pieces_column(tokenizer: str, room: int):
    """Per text its pieces of at most ``room`` tokens: start, length and CRC-32 of the ids, end id included.

    ``nth`` numbers the pieces of each length within the task, from 0.
    """

    @F.pandas_udf("array<struct<piece:int,start:long,length:int,ids_crc32:long,nth:long>>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, seen = encoder(tokenizer), [0] * (room + 1)
        for texts in batches:
            out = []
            for text in texts:
                raw = np.array(encode(text or "") + [END_ID], dtype="<u4").tobytes()
                n, own = len(raw) // 4, []
                for k, at in enumerate(range(0, n, room)):
                    length = min(room, n - at)
                    own.append({"piece": k, "start": at, "length": length, "ids_crc32": zlib.crc32(raw[4 * at:4 * (at + room)]), "nth": seen[length]})
                    seen[length] += 1
                out.append(own)
            yield pd.Series(out)

    return pieces


def _knapsack(price: np.ndarray, count: np.ndarray, room: int) -> Counter:
    """Lengths of the most valuable sequence: a dynamic program over the fill level.

    A length is taken at most as often as ``count`` says. Lengths enter from the longest down, so ties keep
    long pieces, and short ones are left to fill gaps.
    """
    lengths = np.flatnonzero(count)[::-1]
    value = np.zeros(room + 1)
    took = np.zeros((len(lengths), room + 1), dtype=np.int16)
    for i, length in enumerate(lengths):
        times = min(int(count[length]), room // int(length))
        k = 1  # binary splitting of the bound
        while times > 0:
            k = min(k, times)
            gain = np.full(room + 1, -1.0)
            gain[k * length:] = value[:room + 1 - k * length] + k * price[length]
            better = gain > value + 1e-15
            shifted = np.zeros(room + 1, dtype=np.int16)
            shifted[k * length:] = took[i, :room + 1 - k * length]
            took[i] = np.where(better, shifted + k, took[i])
            value = np.where(better, gain, value)
            times -= k
            k *= 2
    config, level = Counter(), room
    for i in range(len(lengths) - 1, -1, -1):
        if took[i, level]:
            config[int(lengths[i])] += int(took[i, level])
            level -= int(took[i, level]) * int(lengths[i])
    return config


def solve_configurations(count: np.ndarray, room: int, rounds: int | None = None, eps: float = 0.5) -> dict[tuple, float]:
    """Weights of configurations (sorted tuples of lengths) that approximately cover ``count``.

    Multiplicative weights: lengths start at their share of the room, which is their price where nothing
    is wasted. Each round the knapsack finds the best configuration at the current weights, it enters with
    the largest step that covers no length twice, and the weights of what it covers fall with the share
    covered. A round uses up at least one length, so as many rounds as there are lengths cover all of them;
    fewer ``rounds`` leave the rest uncovered.
    """
    demand = count.astype(float)
    left = demand.copy()
    weight = np.where(count > 0, np.arange(room + 1) / room, 0.0)
    chosen: Counter = Counter()
    for _ in range(np.count_nonzero(count) if rounds is None else rounds):
        whole = np.floor(left + 1e-9).astype(np.int64)
        config = _knapsack(weight, whole, room)
        if not config:
            break
        step = min(left[length] / k for length, k in config.items())
        chosen[tuple(sorted(config.elements(), reverse=True))] += step
        for length, k in config.items():
            left[length] -= k * step
            weight[length] *= np.exp(-eps * k * step / demand[length])
    return dict(chosen)


def plan_packing(histogram: dict[int, int], room: int, rounds: int | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of sequences per configuration that hold exactly ``histogram``.

    The program's weights are rounded down, never above what is left of a length; the rest goes best fit
    decreasing, on counts: the longest length opens sequences, and the fullest open configuration it fits
    takes as many of it as there are. The work is bounded by room, distinct lengths and configurations,
    not by the number of pieces.
    """
    left = np.zeros(room + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan: Counter = Counter()
    for config, weight in sorted(solve_configurations(left, room, rounds).items(), key=lambda x: (-sum(x[0]), x[0])):
        need = Counter(config)
        times = min([int(weight), *(int(left[length]) // k for length, k in need.items())])
        if times > 0:
            plan[config] += times
            for length, k in need.items():
                left[length] -= k * times
    # best fit decreasing with equal sequences handled together: open[space] = {configuration: number}
    opened: dict[int, Counter] = {}
    spaces = np.zeros(room + 1, dtype=bool)

    def put(config, number):
        space = room - sum(config)
        opened.setdefault(space, Counter())[config] += number
        spaces[space] = True

    for config, number in list(plan.items()):
        if sum(config) < room:
            put(config, number)
            del plan[config]
    for length in range(room, 0, -1):
        rest = int(left[length])
        while rest > 0:
            fits = np.flatnonzero(spaces[length:])
            if not len(fits):
                per = room // length
                whole, over = divmod(rest, per)
                if whole:
                    put((length,) * per, whole)
                if over:
                    put((length,) * over, 1)
                break
            space = int(fits[0]) + length
            config, number = next(iter(opened[space].items()))
            per = space // length
            full = min(number, rest // per)
            taken, each = (full, per) if full else (1, rest)
            opened[space][config] -= taken
            if not opened[space][config]:
                del opened[space][config]
                spaces[space] = bool(opened[space])
            put(config + (length,) * each, taken)
            rest -= taken * each
    for space in opened.values():
        plan.update(space)
    return sorted(((tuple(sorted(c, reverse=True)), n) for c, n in plan.items() if n), key=lambda x: (-sum(x[0]), x[0]))


def _placement(plan, room: int) -> dict[int, tuple]:
    """Per length, the runs of its ranks: first rank, first sequence, copies per sequence, offset."""
    runs: dict[int, list] = {}
    used: Counter = Counter()
    first = 0
    for config, number in plan:
        at = 0
        for length, k in sorted(Counter(config).items(), reverse=True):
            runs.setdefault(length, []).append((used[length], first, k, at))
            used[length] += k * number
            at += k * length
        first += number
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for length, rows in runs.items()}


def _places_column(placement):
    """The plan's size is bounded by room and the distinct lengths, so it may travel with the function."""

    @F.pandas_udf("sequence_id long, offset long")
    def places(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        for size in np.unique(sizes):
            mine = sizes == size
            start, first, k, at = placement[int(size)]
            run = np.searchsorted(start, ranks[mine], side="right") - 1
            inside = ranks[mine] - start[run]
            seq[mine] = first[run] + inside // k[run]
            off[mine] = at[run] + inside % k[run] * size
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return places


def pack(docs: DataFrame, tokenizer: str, room: int = 1024, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in as few sequences of at most ``room`` tokens as the program finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. A document is
    its text's ids and the end id; only documents longer than ``room`` are cut, into full pieces and a rest.
    Null and empty texts are the end id alone. Repeated rows are packed each for itself; extra columns are
    not read; no rows give no rows. Only the histogram of lengths (``room`` numbers) reaches the driver.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.spark_partition_id().alias("task"), pieces_column(tokenizer, room)(F.col(text_col)).alias("pieces"))
    pieces = landed(rows.select("doc_id", "task", F.inline("pieces")), "pieces")
    # a piece's rank in its length: pieces of earlier tasks, then its number in its own task
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = cut_lineage(counts.select("task", "length", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")))
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placement = _placement(plan_packing(histogram, room, rounds), room)
    before = before.drop("n")
    ranked = pieces.join(F.broadcast(before) if before.count() <= MOST_OFFSETS else before, ["task", "length"])
    placed = ranked.withColumn("at", _places_column(placement)(F.col("length"), F.col("before") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "at.sequence_id", "at.offset")

"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, landed, slice_count, without_rows

_KEY = ["digest", "proof", "n_norm"]
FAN = 16  # runs that meet in one task per round


def _digest_columns(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(text, WHITE, "")
    return [
        F.col(id_col).alias("doc_id"), F.length(text).alias("n_points"), F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.xxhash64(norm).alias("proof"), F.octet_length(norm).alias("n_norm"), F.monotonically_increasing_id().alias("row"),
    ]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SHA-256 of the text without white space, an independent 64-bit proof and the normal length."""
    return docs.select(*_digest_columns(id_col, text_col))


def merge_runs(base: DataFrame, fan: int = FAN, runs: int | None = None) -> DataFrame:
    """One row per row of ``base`` with the winner of its group and the group's size.

    Rows are dealt evenly into runs, one partition each; a run is sorted by digest and holds each digest
    once, with its best candidate: most code points, then smallest id (null ids last), then first row. A
    run's number has one digit to the base ``fan`` per round. In a round the ``fan`` runs that differ in
    that digit alone exchange parts: an entry goes to the one whose digit is that of its digest's home, where
    the parts are sorted and merged. Entries merge only if digest, proof and length all agree, so an
    identifier is verified at every level. After the last round a digest is in its home run alone, and all
    runs are still of a size: no task holds the whole. Answers go back down through the same exchanges.
    A group of any size is one entry per run, and at most ``fan`` entries of it meet.
    """
    rounds, least = 1, runs or slice_count(base.sparkSession)
    while fan ** rounds < least:
        rounds += 1
    count = fan ** rounds
    home = F.pmod(F.xxhash64("digest", F.lit("home")), F.lit(count))
    best = F.struct((-F.col("n_points")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    leaves = base.withColumn("run", F.pmod(F.xxhash64("row", F.lit("run")), F.lit(count)).cast("int")).repartitionById(count, F.col("run"))
    level = leaves.groupBy("run", *_KEY).agg(F.min(best).alias("best"), F.count("*").alias("n"))
    exchanged = []
    for k in range(rounds):
        place = fan ** k
        own, goal = F.floor(F.col("run") / place) % fan, F.floor(home / place) % fan
        sent = level.withColumn("to", (F.col("run") + (goal - own) * place).cast("int")).withColumnsRenamed(
            {"run": "from", "to": "run"}).repartitionById(count, F.col("run"))
        exchanged.append(sent)
        level = sent.groupBy("run", *_KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    answers = level.select("run", *_KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))
    for sent in reversed(exchanged):
        answers = sent.select("run", "from", *_KEY).join(answers, ["run", *_KEY]).drop("run").withColumnRenamed("from", "run")
    return leaves.join(answers, ["run", *_KEY]).drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are equal without white space: one row per input row.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty, and empty texts
    form one group. Repeated rows, also with one id, are copies: only one of them is kept. A null id is
    kept only where its group has no other of that length. Extra columns are not read; an empty table
    gives an empty result.
    """
    merged = merge_runs(landed(digests(docs, id_col, text_col), "digests"))
    return merged.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they came.

    Row numbers are fixed by landing the rows once with their digests; only the numbers of rows that go are
    joined back. Null texts count as empty, repeated rows as copies; no rows give no rows.
    """
    rows = landed(docs.select(
        F.struct(*docs.columns).alias("doc"), F.struct(*_digest_columns(id_col, text_col)).alias("d")), "digest-docs")
    gone = merge_runs(rows.select("d.*")).where("row <> keep_row").select("row")
    return without_rows(rows, F.col("d.row"), gone).select("doc.*")

"""Benchmark decontamination with a hash set of test windows, in DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import landed, slice_count, slice_of, spread_lookup, without_rows
from tidemark.session import cut_lineage

WIDTH = 13
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what separates words; A-Z are lower-cased first
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20  # windows of a measured size above this go through a shuffled join


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def bench_windows(bench: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (b_key, b_gram, set), and the ids of the items of each set; a short item is one window.

    Windows with the same items share a set, so what looks windows up carries a number and no ids.
    """
    items = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    grams = items.select("item", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1))), lambda i: F.slice("w", i, width))).alias("b_gram"))
    owned = cut_lineage(grams.groupBy("b_gram").agg(F.array_sort(F.collect_set("item")).alias("items")))
    sets = cut_lineage(owned.select("items").distinct().withColumn("set", F.monotonically_increasing_id()))
    return cut_lineage(owned.join(sets, "items").select(F.xxhash64("b_gram").alias("b_key"), "b_gram", "set")), sets


def _mark(row: Column, count: int) -> Column:
    """A gram that no text holds, since words are not empty; marks are dealt over ``count`` of them."""
    return F.array(F.lit(""), slice_of([row], count).cast("string"))


def _hits(rows: DataFrame, wins: DataFrame, marks: bool = False) -> DataFrame:
    """One row per verified hit of ``rows`` (row, w and more), and with ``marks`` one per document with gram_len 0.

    Every window is hashed once and looked up in the set; the words decide. A mark rides through the same
    join, so texts are read once; marks have as many keys as there are slices, so none is hot.
    """
    carried = [c for c in rows.columns if c != "w"]
    lengths = sorted(r[0] for r in wins.select(F.size("b_gram")).distinct().collect())  # at most ``width`` numbers
    size = wins.agg(F.sum(F.octet_length(F.array_join("b_gram", " ")) + 16 * F.size("b_gram") + 32)).first()[0] or 0
    probe, slices = wins, slice_count(wins.sparkSession)
    if marks:
        gram = F.array(F.lit(""), F.col("id").cast("string"))
        probe = wins.unionByName(wins.sparkSession.range(slices).select(
            F.xxhash64(gram).alias("b_key"), gram.alias("b_gram"), F.lit(None).cast("long").alias("set")))
    first = -1 if marks else 0
    last = F.size("w") - (min(lengths) if lengths else WIDTH)
    at = rows.withColumn("pos", F.explode(F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(
        F.array(F.lit(-1)) if marks else F.array().cast("array<int>"))))  # sequence() must not count downwards
    if len(lengths) > 1:
        at = at.withColumn("len", F.explode(F.array(*[F.lit(n) for n in lengths]))).where(
            f"(pos >= 0 and pos + len <= size(w)) or (pos = -1 and len = {lengths[-1]})")
    else:
        at = at.withColumn("len", F.lit(lengths[0] if lengths else WIDTH))
    own = F.slice("w", F.greatest(F.col("pos") + 1, F.lit(1)), F.col("len"))
    grams = at.select(*carried, F.size("w").alias("n_words"), "pos", F.when(
        F.col("pos") >= 0, own).otherwise(_mark(F.col("row"), slices)).alias("gram") if marks else own.alias("gram"))
    probe = F.broadcast(probe) if size <= BROADCAST_BYTES else probe.hint("shuffle_merge")
    return grams.join(probe, (F.xxhash64("gram") == F.col("b_key")) & (F.col("gram") == F.col("b_gram"))).select(
        *carried, "n_words", "pos", F.when(F.col("pos") < 0, 0).otherwise(F.size("gram")).alias("gram_len"), "set")


def _new_words() -> Column:
    """Words of a hit that no earlier hit of its document covers."""
    upto = Window.partitionBy("row").orderBy("pos", "gram_len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("gram_len")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("pos"), F.coalesce(F.max(end).over(upto), F.lit(0))))
    return F.when(F.col("gram_len") > 0, fresh).otherwise(0)


def _contaminated(share: int) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def _judged(hits: DataFrame, keys: list[str], share: int) -> DataFrame:
    """Per document the words covered by the union of its hits, the item sets, and the verdict."""
    out = hits.withColumn("new", _new_words()).groupBy(*keys).agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum("new").cast("long").alias("n_hit"), F.collect_set("set").alias("sets"))
    return out.withColumn("contaminated", _contaminated(share))


def find_contamination(docs: DataFrame, bench: DataFrame, width: int = WIDTH, share: int = 20, id_col: str = "doc_id",
                       text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text") -> DataFrame:
    """Which documents hold windows of benchmark items, one row per row of ``docs``.

    A document is contaminated if ``share`` times its hit words reach its words. Null and empty texts have
    no words and are clean; items without words have no windows; an item without id counts for hits only.
    Repeated rows are judged each for itself. An empty benchmark hits nothing; extra columns are not read.
    """
    wins, sets = bench_windows(bench, width, bench_id, bench_text)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    judged = cut_lineage(_judged(_hits(rows, wins, marks=True), ["row", "doc_id"], share))
    held = spread_lookup(judged.select("row", F.explode("sets").alias("set")), ["set"], sets, "row")
    items = held.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    none = F.array().cast("array<string>")
    return judged.join(items, "row", "left").withColumn("item_ids", F.coalesce("item_ids", none)).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "contaminated")


def remove_contamination(docs: DataFrame, bench: DataFrame, mode: str = "documents", width: int = WIDTH, share: int = 20,
                         text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or with the hit words cut out of their texts.

    Mode ``documents`` drops rows over the share; mode ``spans`` drops each hit word with what follows it
    up to the next word, and keeps all rows. Other columns stay as they came.
    """
    wins, _ = bench_windows(bench, width, bench_id, bench_text)
    if mode == "documents":  # a verdict hangs on the text alone, so the digests of the texts that go are enough
        digest = F.sha2(F.col(text_col), 256)
        rows = docs.select(F.monotonically_increasing_id().alias("row"), digest.alias("text_digest"), words(F.col(text_col)).alias("w"))
        gone = _judged(_hits(rows, wins), ["row", "text_digest"], share).where("contaminated").select("text_digest").distinct()
        return without_rows(docs, digest, gone)
    if mode != "spans":
        raise ValueError(f"unknown mode {mode}")
    kept = landed(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "decontaminate")
    hits = _hits(kept.select("row", words(F.col(f"doc.{text_col}")).alias("w")), wins)
    spans = hits.groupBy(F.col("row").alias("hit_row")).agg(
        F.collect_set(F.struct("pos", (F.col("pos") + F.col("gram_len")).alias("end"))).alias("spans"))
    text = F.col(f"doc.{text_col}")
    own = F.array_remove(F.split(text, BETWEEN), "")
    gaps = F.split(text, WORD, -1)
    parts = F.transform(own, lambda w, i: F.when(
        F.exists("spans", lambda s: (s["pos"] <= i) & (i < s["end"])), F.lit("")).otherwise(F.concat(w, F.get(gaps, i + 1))))
    cut = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.get(gaps, F.lit(0)), F.array_join(parts, "")))
    out = kept.join(spans, F.col("row") == F.col("hit_row"), "left").withColumn("cut", cut)
    return out.select(*[F.col("cut").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])

"""Comment trees: thread roots, depths, depth-first order, thread texts and statistics.

Every comment holds a pointer to an ancestor and doubles its reach each round, so a tree of depth
``d`` needs about log2(d) joins instead of d. Rows are of fixed size: a comment's place in its thread
is a number, found by weighted pointer jumping, never a path. Joins run on (submission, comment id);
many comments that point at one ancestor are dealt over slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.text import strip
from tidemark.operators.spread import in_order, spread_lookup
from tidemark.session import cut_lineage


def _linked(comments: DataFrame) -> DataFrame:
    """One row per comment: pos, ``up`` (NULL above threads and for replies to nothing) and ``top``."""
    parent = F.when(F.col("parent_id").startswith("t1_"), F.expr("substring(parent_id, 4)"))
    top = F.coalesce(F.col("parent_id").startswith("t3_"), F.lit(False))
    links = comments.groupBy("submission_id", "id").agg(
        F.min(F.struct("pos", parent.alias("up"), top.alias("top"))).alias("l")).select("submission_id", "id", "l.*")
    known = links.select("submission_id", F.col("id").alias("up"), F.lit(True).alias("found"))
    found = spread_lookup(links.where("up is not null"), ["submission_id", "up"], known, "id")
    return cut_lineage(links.where("up is null").unionByName(
        found.select("submission_id", "id", "pos", F.when(F.col("found"), F.col("up")).alias("up"), "top")))


def _thread_sizes(links: DataFrame) -> DataFrame:
    """Comments below and including each one; those that run in a circle have none.

    After round k a size counts what is less than 2^k below. The comments exactly 2^k below bring what is
    less than 2^k below them, so both reaches double.
    """
    state = links.select("submission_id", "id", F.col("up").alias("above"), F.lit(1).cast("long").alias("size"))
    left, before = state.where("above is not null").count(), -1
    while left and left != before:
        under = state.where("above is not null")
        brought = under.groupBy("submission_id", F.col("above").alias("id")).agg(F.sum("size").alias("more"))
        target = state.select("submission_id", F.col("id").alias("above"), F.col("above").alias("next"))
        moved = spread_lookup(under, ["submission_id", "above"], target, "id").select("submission_id", "id", F.col("next").alias("above"), "size")
        state = cut_lineage(state.where("above is null").unionByName(moved).join(brought, ["submission_id", "id"], "left").select(
            "submission_id", "id", "above", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        left, before = state.where("above is not null").count(), left
    return state.where("above is null").select("submission_id", "id", "size")


def locate_comments(comments: DataFrame, depth_cap: int | None = None) -> DataFrame:
    """Adds ``root`` (NULL when no top-level comment is reached), ``depth`` and ``rank``.

    ``rank`` numbers a thread's comments from 0 in depth-first order, siblings by file position. A comment
    comes one after its parent and after all that is below its earlier siblings; these steps add up along
    the way to the root. Top-level comments and replies to nothing are settled before the first join.
    Rounds go on until no pointer moves; chains that run in a circle never reach an end and have no depth
    and rank. Repeated comments share their place. ``depth_cap`` limits the depth that is reported.
    """
    links = _linked(comments)
    ends = links.where("up is null").select(
        "submission_id", "id", F.col("id").alias("at"), F.when(F.col("top"), F.col("id")).alias("root"),
        F.col("top").cast("long").alias("depth"), F.lit(0).cast("long").alias("rank"), F.lit(True).alias("settled"))
    sized = links.where("up is not null").join(_thread_sizes(links), ["submission_id", "id"])
    steps = in_order(sized, ["submission_id", "up"], ["pos", "id"], {"ahead": F.col("size")})
    replies = steps.select(
        "submission_id", "id", F.col("up").alias("at"), F.lit(None).cast("string").alias("root"), F.lit(1).cast("long").alias("depth"),
        (F.col("ahead") + 1).alias("rank"), F.lit(False).alias("settled"))
    state = cut_lineage(ends.unionByName(replies))
    left = state.where("not settled").count()
    while left:
        # after some rounds all comments of a thread point at its root: the lookup deals them over slices
        target = state.select(
            "submission_id", F.col("id").alias("at"), F.col("at").alias("next"), F.col("root").alias("its_root"),
            F.col("depth").alias("more"), F.col("rank").alias("further"), F.col("settled").alias("done"))
        moved = spread_lookup(state.where("not settled"), ["submission_id", "at"], target, "id").select(
            "submission_id", "id", F.col("next").alias("at"), F.col("its_root").alias("root"),
            (F.col("depth") + F.col("more")).alias("depth"), (F.col("rank") + F.col("further")).alias("rank"), F.col("done").alias("settled"))
        state = cut_lineage(state.where("settled").unionByName(moved))
        left = state.where("not settled").count()
    depth = (F.least("depth", F.lit(depth_cap)) if depth_cap else F.col("depth")).cast("int")
    return comments.join(state.select("submission_id", "id", "root", "rank", depth.alias("depth")), ["submission_id", "id"], "left")


def thread_texts(located: DataFrame) -> DataFrame:
    """One line per top-level comment with its scored replies, depth first, empty bodies skipped.

    The line itself is the output unit, so it holds its whole thread; ``located`` ordered by
    ``root`` and ``rank`` is the form without that limit.
    """
    body = strip(F.coalesce("body", F.lit("")))
    scored = F.concat(body, F.lit(" (score "), F.coalesce("score", F.lit(0)).cast("string"), F.lit(")"))
    is_root = F.col("root") == F.col("id")
    rows = located.where("root is not null").select(
        "submission_id", "root", "rank", "pos", is_root.alias("is_root"),
        F.when(body != "", scored).alias("line"),
    )
    reply = F.when(~F.col("is_root") & F.col("line").isNotNull(), F.struct("rank", "line"))
    threads = rows.groupBy("submission_id", "root").agg(
        F.max(F.when(F.col("is_root"), F.col("line"))).alias("head"),
        F.max(F.when(F.col("is_root"), F.col("pos"))).alias("pos"),
        F.sort_array(F.collect_list(reply)).alias("replies"),
    )
    tail = F.array_join(F.transform("replies", lambda r: r["line"]), "; ")
    line = F.concat(
        F.lit("Top level comment: "), "head",
        F.when(F.size("replies") > 0, F.concat(F.lit("; Replies: "), tail)).otherwise(""),
    )
    return threads.where("head is not null").select(
        "submission_id", "root", "pos", F.size("replies").alias("n_replies"), line.alias("thread")
    )


def thread_documents(submissions: DataFrame, texts: DataFrame) -> DataFrame:
    """API submissions with their threads as ``comments``, the body entry first."""
    lists = texts.groupBy("submission_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "thread"))), lambda t: t["thread"]).alias("threads")
    )
    body = F.concat(F.lit("Submission body: "), strip(F.coalesce("selftext", F.lit(""))))
    return submissions.join(lists, "submission_id", "left").select(
        *submissions.columns,
        F.concat(F.array(body), F.coalesce("threads", F.array().cast("array<string>"))).alias("comments"),
    )


def comment_statistics(located: DataFrame) -> DataFrame:
    """Counts and scores per submission; grouped by thread first, so hot submissions merge early."""
    empty = strip(F.coalesce("body", F.lit(""))) == ""
    is_root = F.col("root") == F.col("id")
    score = F.coalesce("score", F.lit(0))
    per_thread = located.groupBy("submission_id", "root").agg(
        F.count("*").alias("n"),
        F.count(F.when(is_root, 1)).alias("tops"),
        F.count(F.when(empty, 1)).alias("empties"),
        F.count(F.when(~is_root & ~empty, 1)).alias("told_replies"),
        F.count(F.when(is_root & ~empty, 1)).alias("told_top"),
        F.max(score).alias("hi"), F.min(score).alias("lo"), F.sum(score).alias("total"),
    )
    rooted = F.col("root").isNotNull()
    n, empties = F.sum("n"), F.sum("empties")
    return per_thread.groupBy("submission_id").agg(
        n.alias("total"),
        F.sum("tops").alias("top_level"),
        F.sum(F.when(rooted, F.col("n") - F.col("tops")).otherwise(0)).alias("replies"),
        empties.alias("empty"),
        F.sum("tops").alias("threads"),
        F.count(F.when(rooted & (F.col("told_replies") > 0) & (F.col("told_top") > 0), 1)).alias("threads_with_replies"),
        F.max("hi").alias("max_score"), F.min("lo").alias("min_score"),
        F.sum("total").alias("total_score"), (F.sum("total") / n).alias("avg_score"),
        ((n - empties) / n * 100).alias("success_rate"),
    )

"""Daily consensus kept up to date batch by batch.

Three logs, each written once per batch: category cells, resolved opinions and consensus rows, sorted by
date inside their files, so a reader skips the pages of other days. A batch reads no raw history.
Opinions are judged again only where the batch has new cells for their (date, submission, ticker); a
consensus row is built again only where one of its opinions changed. Readers take the newest row of
each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark.operators.conflicts import KEYS, ConflictRules, judge_cells, opinion_cells, resolved_opinions
from tidemark.operators.consensus import daily_consensus

DAYS_LISTED = 400  # touched days named in a scan; of more days the scan gets the span, the joins decide either way


def _log(df: DataFrame, path: str, batch: int) -> DataFrame:
    """Replace what this batch wrote before and return the whole log."""
    df.sortWithinPartitions("date").write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return df.sparkSession.read.schema(StructType(df.schema.fields).add("batch", "integer")).parquet(path)


def _touched(rows: DataFrame) -> Column | None:
    """A predicate on the days of ``rows``, for pages to be skipped; one value per calendar day is collected."""
    days = sorted(r[0] for r in rows.select("date").distinct().collect() if r[0] is not None)
    if not days:
        return None
    return F.col("date").isin(days) if len(days) <= DAYS_LISTED else F.col("date").between(days[0], days[-1])


def newest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last written row of each key."""
    rest = [c for c in log.columns if c not in (*keys, "batch")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, "r.*").select(*[c for c in log.columns if c != "batch"])


def keep_consensus(state: str, rules: ConflictRules = ConflictRules()):
    """Batch handler: opinions in, consensus rows of the changed (date, ticker) pairs out."""

    def handle(rows: DataFrame, batch: int) -> None:
        log = _log(opinion_cells(rows, rules), f"{state}/cells", batch)
        fresh = log.where(F.col("batch") == batch)
        here = _touched(fresh)
        if here is None:
            return
        before = log.where((F.col("batch") < batch) & here)
        first = not before.select("batch").head(1)
        cells = fresh if first else fresh.unionByName(before.join(fresh.select(*KEYS), KEYS, "left_semi"))
        opinions = _log(resolved_opinions(judge_cells(cells.drop("batch"), rules)), f"{state}/opinions", batch)
        changed = opinions.where(F.col("batch") == batch)
        if first:
            told = changed.drop("batch")
        else:
            same_pair = opinions.where((F.col("batch") <= batch) & here).join(changed.select("date", "ticker"), ["date", "ticker"], "left_semi")
            told = newest(same_pair, KEYS)
        _log(daily_consensus(told), f"{state}/daily", batch)

    return handle


def current_consensus(spark: SparkSession, state: str) -> DataFrame:
    """The consensus as of the last batch."""
    return newest(spark.read.parquet(f"{state}/daily"), ["date", "ticker"])

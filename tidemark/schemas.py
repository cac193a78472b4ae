"""Table schemas and closed value domains, declared once."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the closed domains of an opinion record -----------------
SENTIMENTS = ("bullish", "bearish", "neutral", "unclear")
POSITIONS = ("shares", "calls", "puts", "spreads", "watching", "unclear")
CONVICTIONS = ("yolo", "high", "moderate", "low", "hedge", "unclear")
HORIZONS = ("day", "swing", "long", "unclear")
SOURCES = ("submission", "comments", "both")
RELATIONSHIPS = ("inverse", "correlated", "causal")

# --- fixed values: the three conviction scales ------------------------------
RESOLUTION_WEIGHTS = {"yolo": 10, "high": 8, "moderate": 6, "low": 4, "hedge": 3, "unclear": 2}
RANKING_WEIGHTS = {"yolo": 10, "high": 8, "moderate": 6, "low": 4, "hedge": 3, "unclear": 1}
CONSENSUS_WEIGHTS = {"low": 1.0, "medium": 2.0, "high": 3.0}

# --- fixed values: texts that stand for removed content ---------------------
REMOVED_MARKERS = ("[removed]", "[deleted]")

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


DUMP_LINE = _struct(
    ("author", S), ("title", S), ("score", L), ("created_utc", L), ("permalink", S),
    ("link_id", S), ("id", S), ("subreddit", S), ("selftext", S), ("url", S), ("body", S),
    ("_corrupt_record", S),
)
CSV_SUBMISSION = _struct(
    ("author", S), ("title", S), ("score", L), ("created", S), ("link", S), ("text", S), ("url", S)
)
CSV_COMMENT = _struct(("author", S), ("score", L), ("created", S), ("link", S), ("body", S))

SENTIMENT = _struct(
    ("confidence", I), ("ticker", S), ("is_implicit", B), ("sentiment", S),
    ("sentiment_intensity", I), ("position", S), ("conviction", S), ("time_horizon", S),
    ("source", S), ("explanation", S), ("extraction_refusal", B),
)
RELATIONSHIP = _struct(
    ("ticker1", S), ("ticker2", S), ("relationship_type", S), ("description", S), ("confidence", I)
)
EXTRACTION = _struct(
    ("primary_ticker", S),
    ("sentiments", T.ArrayType(SENTIMENT)),
    ("ticker_relationships", T.ArrayType(RELATIONSHIP)),
)
DOCUMENT_METADATA = _struct(
    ("original_score", L), ("author", S), ("original_link", S), ("comment_count", L),
    ("valid_comment_count", L), ("conversion_source", S), ("url", S), ("cleaning_applied", B),
    ("year_filtering_applied", B),
    ("comment_breakdown", _struct(("top_level_comments", L), ("total_replies", L),
                                  ("empty_comments", L), ("threads_with_replies", L))),
    ("data_quality", _struct(("comments_with_scores", L), ("deleted_comments", L),
                             ("processing_success_rate", D))),
)
DOCUMENT = _struct(
    ("submission_id", S), ("title", S), ("date", S), ("subreddit", S),
    ("comments", T.ArrayType(S)), ("metadata", DOCUMENT_METADATA),
)
PRICE = _struct(
    ("ticker", S), ("date", T.DateType()), ("open", D), ("high", D), ("low", D), ("close", D),
    ("volume", L),
)

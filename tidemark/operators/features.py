"""Relevance features of a submission document, as native columns.

Input rows carry ``title``, ``comments`` and optionally ``original_score``. Every extractor is a
function from the prepared texts to named columns, so users can add their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import (
    count_capitals, count_chars, count_segments, words,
)

# --- fixed values: word lists, patterns and titles that decide the features ---
TICKERS = (
    "AAPL", "MSFT", "GOOGL", "GOOG", "AMZN", "TSLA", "META", "NVDA", "BRK.A", "BRK.B", "UNH", "JNJ", "JPM", "V", "PG",
    "HD", "CVX", "MA", "BAC", "ABBV", "PFE", "AVGO", "KO", "MRK", "COST", "PEP", "TMO", "WMT", "ACN", "MCD", "ABT", "VZ",
    "ADBE", "NFLX", "CRM", "NKE", "DHR", "TXN", "NEE", "RTX", "QCOM", "ORCL", "CMCSA", "AMD", "INTC", "IBM", "UBER",
    "PYPL", "SHOP", "SQ", "ROKU", "ZM", "PTON",
)
# a dollar symbol anywhere, or a standalone word before white space or the end; "XYZ stock" is a case of the latter
TICKER_PATTERN = r"(?U)\$[A-Z]{1,5}\b|\b[A-Z]{1,5}(?=\s|$)"
HIGH_WORDS = (
    "buy", "sell", "hold", "calls", "puts", "options", "shares", "stock", "stocks", "position", "portfolio", "investment",
    "trading", "ticker", "earnings", "dividend", "bull", "bear", "bullish", "bearish", "long", "short",
)
MEDIUM_WORDS = (
    "company", "business", "financial", "finance", "money", "price", "value", "growth", "analyst", "forecast", "target",
    "upgrade", "downgrade",
)
LOW_WORDS = ("market", "economy", "economic", "news", "report", "quarter", "annual")
KEYWORDS = HIGH_WORDS + MEDIUM_WORDS + LOW_WORDS
PSYCHOLOGY_WORDS = (
    "psychology", "psychological", "emotion", "emotional", "fear", "greed", "anxiety", "stress", "worried", "nervous",
    "confidence", "doubt",
)
ADVICE_PHRASES = (
    "should i", "what should", "how to", "need help", "advice", "beginner", "newbie", "help me", "can someone",
)
HELP_WORDS = ("help", "guidance", "suggestions", "recommendations")
UNCERTAIN_WORDS = ("maybe", "perhaps", "might", "could", "unsure", "confused")
EMOTION_WORDS = ("scared", "excited", "worried", "happy", "sad", "angry", "frustrated")
THREAD_TITLES = {
    "is_penny_stock_discussion": "🇹‌🇭‌🇪‌ 🇱‌🇴‌🇺‌🇳‌🇬‌🇪‌",
    "is_earnings_discussion": "upcoming earnings",
    "is_theta_daily_discussion": "daily r/thetagang discussion thread",
    "is_daily_stock_discussion": "daily general discussion and advice thread",
    "is_daily_discussion_thread": "daily discussion thread",
    "is_wsb_daily_discussion": "what are your moves tomorrow",
}
SCORE_PATTERN = r"\(score (-?\d+)\)"
GOOD_SCORE = 5
# at least two characters between blanks, some capital and no lower-case letter
CAPS_WORD = r"(?U)(?<!\S)(?=\S*\p{IsUppercase})[^\s\p{IsLowercase}]{2,}(?!\S)"

Extractor = Callable[[], dict[str, Column]]


_HELPERS = ("_title", "_comments", "_text", "_lower", "_words", "_high", "_medium", "_low", "_in_title", "_sentences", "_scores")


def title() -> Column:
    return F.col("_title")


def comments() -> Column:
    return F.col("_comments")


def all_text() -> Column:
    return F.col("_text")


def lowered() -> Column:
    return F.col("_lower")


def all_words() -> Column:
    return F.col("_words")


def title_words() -> Column:
    return F.size(words(title()))


def _prepared(docs: DataFrame) -> DataFrame:
    """Shared inputs, computed once per row."""
    docs = docs.withColumns({
        "_title": F.coalesce("title", F.lit("")),
        "_comments": F.coalesce("comments", F.array().cast("array<string>")),
    })
    docs = docs.withColumn("_text", F.concat(title(), F.lit(" "), F.array_join(comments(), " ")))
    docs = docs.withColumns({"_lower": F.lower(all_text()), "_words": words(all_text())})
    head = F.lower(title())
    # counts that several features share
    return docs.withColumns({
        "_high": _hits(lowered(), HIGH_WORDS), "_medium": _hits(lowered(), MEDIUM_WORDS), "_low": _hits(lowered(), LOW_WORDS),
        "_in_title": _hits(head, KEYWORDS), "_sentences": count_segments(all_text(), ".!?"),
        "_scores": _score_sums(),
    })


def _hits(text: Column, needles) -> Column:
    """How many needles occur; plain substring tests beat one large pattern several times over."""
    total = F.lit(0)
    for needle in needles:
        total = total + text.contains(needle).cast("int")
    return total


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def tickers_in(text: Column, known, any_case: bool = True) -> Column:
    """Known symbols found in a text, as written with or without a dollar; one pass over the text."""
    pattern = TICKER_PATTERN.replace("A-Z", "A-Za-z") if any_case else TICKER_PATTERN
    candidates = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if any_case:
        candidates = F.split(F.upper(F.array_join(candidates, " ")), " ")
    return F.array_intersect(candidates, F.array(*[F.lit(form) for k in known for form in (k, f"${k}")]))


def ticker_features(known=TICKERS, any_case: bool = True) -> Extractor:
    def symbols(hits):
        return F.array_distinct(F.transform(hits, lambda m: F.ltrim(m, F.lit("$"))))

    def columns():
        hits = tickers_in(all_text(), known, any_case)
        found = F.size(symbols(hits))
        in_title = F.size(symbols(tickers_in(title(), known, any_case)))
        return {
            "ticker_count": found,
            "explicit_ticker_count": F.size(F.filter(hits, lambda m: m.startswith("$"))),
            "ticker_in_title": in_title > 0,
            "ticker_density": _ratio(found, F.size(all_words())) * 100,
            "unique_tickers": found,
            "ticker_title_ratio": _ratio(in_title, title_words()),
        }

    return columns


def keyword_features() -> dict[str, Column]:
    total = F.col("_high") + F.col("_medium") + F.col("_low")
    return {
        "high_relevance_keywords": F.col("_high"),
        "medium_relevance_keywords": F.col("_medium"),
        "low_relevance_keywords": F.col("_low"),
        "total_keyword_count": total,
        "keyword_density": _ratio(total, F.size(all_words())) * 100,
        "title_keyword_count": F.col("_in_title"),
        "title_keyword_density": _ratio(F.col("_in_title"), title_words()) * 100,
        "unique_keyword_ratio": total / len(KEYWORDS),
    }


def psychology_features() -> dict[str, Column]:
    text = lowered()
    return {
        "psychology_keyword_count": _hits(text, PSYCHOLOGY_WORDS),
        "advice_pattern_count": _hits(text, ADVICE_PHRASES),
        "question_count": count_chars(text, "?"),
        "help_seeking_count": _hits(text, HELP_WORDS),
        "uncertainty_indicators": _hits(text, UNCERTAIN_WORDS),
        "emotional_language_count": _hits(text, EMOTION_WORDS),
    }


def structure_features(with_score: bool = False) -> Extractor:
    def columns():
        in_comments = F.aggregate(comments(), F.lit(0).cast("bigint"), lambda acc, c: acc + F.length(c))
        n = F.size(comments())
        first = F.try_element_at(comments(), F.lit(1))
        return {
            "title_length": F.length(title()),
            "total_text_length": F.length(title()) + in_comments,
            "comment_count": n,
            "avg_comment_length": _ratio(in_comments, n),
            "submission_score": F.coalesce("original_score", F.lit(0)) if with_score else F.lit(0),
            "title_word_count": title_words(),
            "text_to_title_ratio": _ratio(F.length(title()) + in_comments, F.length(title())),
            "has_submission_body": F.coalesce(first.startswith("Submission body:"), F.lit(False)),
        }

    return columns


def _score_sums() -> Column:
    """All sums over the comment scores in one pass; squares are taken around the first score."""
    raw = F.transform(comments(), lambda c: F.regexp_extract(c, SCORE_PATTERN, 1))
    scores = F.transform(F.filter(raw, lambda s: s != ""), lambda s: s.cast("bigint"))
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    start = F.struct(zero.alias("n"), none.alias("base"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), none.alias("hi"), none.alias("lo"),
                     zero.alias("good"), zero.alias("negative"), zero.alias("positive"))

    def step(acc, s):
        base = F.coalesce(acc["base"], s)
        off = (s - base).cast("double")
        return F.struct(
            (acc["n"] + 1).alias("n"), base.alias("base"), (acc["s"] + off).alias("s"), (acc["q"] + off * off).alias("q"),
            F.greatest(acc["hi"], s).alias("hi"), F.least(acc["lo"], s).alias("lo"), (acc["good"] + (s >= GOOD_SCORE).cast("bigint")).alias("good"),
            (acc["negative"] + (s < 0).cast("bigint")).alias("negative"), (acc["positive"] + (s > 0).cast("bigint")).alias("positive"))

    return F.aggregate(scores, start, step)


def engagement_features() -> dict[str, Column]:
    a = F.col("_scores")
    n, mean_off = a["n"], F.try_divide(a["s"], a["n"])
    return {
        "avg_comment_score": a["base"] + mean_off,
        "max_comment_score": a["hi"],
        "min_comment_score": a["lo"],
        "high_score_comments": a["good"].cast("double"),
        "negative_score_comments": a["negative"].cast("double"),
        "score_variance": F.greatest(F.try_divide(a["q"], n) - mean_off * mean_off, F.lit(0.0)),
        "score_range": a["hi"] - a["lo"],
        "positive_engagement_ratio": F.try_divide(a["positive"].cast("double"), n),
    }


def quality_features() -> dict[str, Column]:
    text, n, sentences = all_text(), F.size(all_words()), F.col("_sentences")
    letters = F.length(text) - F.regexp_count(text, F.lit(r"(?U)\s"))
    return {
        "uppercase_ratio": count_capitals(text) / F.length(text),
        "punctuation_density": count_chars(text, ".,!?;:") / F.length(text),
        "avg_word_length": _ratio(letters, n),
        "unique_word_ratio": _ratio(F.size(F.array_distinct(all_words())), n),
        "sentence_count": sentences,
        "avg_sentence_length": F.when(n == 0, 0).otherwise(_ratio(F.length(text), sentences)),
        "exclamation_count": count_chars(text, "!"),
        "caps_word_count": F.regexp_count(text, F.lit(CAPS_WORD)),
    }


def thread_flags() -> dict[str, Column]:
    head = F.lower(title())
    return {name: head.contains(needle) for name, needle in THREAD_TITLES.items()}


def default_extractors(known=TICKERS, with_score: bool = False) -> dict[str, Extractor]:
    """Extractors in their fixed order."""
    return {
        "ticker": ticker_features(known),
        "keyword": keyword_features,
        "psychology": psychology_features,
        "structure": structure_features(with_score),
        "engagement": engagement_features,
        "quality": quality_features,
        "threads": thread_flags,
    }


def extract(docs: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """The input with one DOUBLE column per feature; what cannot be computed is 0."""
    with_score = "original_score" in docs.columns
    out = _prepared(docs)
    named = {}
    for columns in (extractors or default_extractors(with_score=with_score)).values():
        named.update(columns())
    out = out.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in named.items()])
    return out.drop(*_HELPERS)


def feature_names(extractors: dict[str, Extractor] | None = None) -> list[str]:
    return [n for columns in (extractors or default_extractors()).values() for n in columns()]


def assemble(features: DataFrame, names: list[str], output: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=names, outputCol=output, handleInvalid="error").transform(features)


# ------------------------------------------------------------ token windows

def token_windows(docs: DataFrame, text: Column, length: int = 256, stride: int = 64,
                  max_chars: int | None = None) -> DataFrame:
    """Overlapping windows of white-space tokens, one row each; short texts give one window.

    Whole texts by default; ``max_chars`` cuts them first.
    """
    source = F.substring(text, 1, max_chars) if max_chars else text
    rows = docs.withColumn("_tokens", words(source)).where(F.size("_tokens") > 0)
    starts = F.sequence(F.lit(0), F.size("_tokens") - 1, F.lit(min(stride, length)))
    return rows.withColumn("start", F.explode(starts)).withColumn(
        "window", F.slice("_tokens", F.col("start") + 1, F.lit(length))
    ).drop("_tokens")


def mean_pool(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Mean vector per key; sums are merged on the map side, so a hot key costs one vector per task."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    as_vector = vectors.select(key, array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    pooled = as_vector.groupBy(key).agg(Summarizer.mean(F.col("v")).alias("v"), F.count("*").alias("n_windows"))
    return pooled.select(key, "n_windows", vector_to_array("v").alias(column))


def encode_windows(windows: DataFrame, load: Callable[[], Callable]) -> DataFrame:
    """User hook: ``load()`` runs once per Python worker and returns ``list[str] -> list[vector]``."""

    def run(batches):
        import pandas as pd

        model = load()
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in model(list(batch))])

    encode = F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR_ITER)
    return windows.withColumn("vector", encode(F.array_join("window", " ")))


def prescore(docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """User hook: a boolean column or boolean pandas UDF decides; by default every row stays."""
    return docs if keep is None else docs.where(keep)

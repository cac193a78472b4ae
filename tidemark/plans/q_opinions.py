"""Opinion records to daily consensus and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import conflicts as X, consensus as C
from tidemark.plans.registry import query
from tidemark.plans.views import with_views
from tidemark.schemas import RESOLUTION_WEIGHTS, SENTIMENTS

G = "date, submission_id, ticker"
DAY = "cast(date as varchar) as date"


def day(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("string"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# ------------------------------------------------------------------ filters

GOOD = "select * from sentiments where not extraction_refusal and confidence >= 5 and sentiment_intensity >= 3"
PREF = f"""select * from (select *, bool_or(not is_implicit) over (partition by {G}) as has_explicit from good)
 where not has_explicit or not is_implicit"""
_KEY_COLS = ["date", "submission_id", "ticker", "pos"]
_KEY_SQL = f"select {DAY}, submission_id, ticker, pos from "


@query("f06_quality_filter", with_views(_KEY_SQL + "good", "sentiments", good=GOOD))
def _(t):
    return day(X.quality_opinions(t.sentiments)).select(_KEY_COLS)


@query("f07_prefer_explicit", with_views(
    f"select {DAY}, submission_id, ticker, has_explicit, count(*) as n from pref group by all",
    "sentiments", good=GOOD, pref=PREF))
def _(t):
    # two-step flag instead of a window: the group is never held together
    good = X.quality_opinions(t.sentiments)
    per_kind = good.groupBy("date", "submission_id", "ticker", "is_implicit").agg(F.count("*").alias("n"))
    explicit = F.sum(F.when(~F.col("is_implicit"), F.col("n")))
    out = per_kind.groupBy("date", "submission_id", "ticker").agg(
        explicit.isNotNull().alias("has_explicit"), F.coalesce(explicit, F.sum("n")).alias("n"))
    return day(out)


@query("f08_usable_opinions", with_views(
    _KEY_SQL + "sentiments where not extraction_refusal and trim(upper(replace(ticker, '$', ''))) <> ''",
    "sentiments"))
def _(t):
    return day(X.usable_opinions(t.sentiments)).select(_KEY_COLS)


@query("f09_submissions_with_opinions", with_views(
    """select cast(o.o_orderkey as bigint) as submission_id, count(*) as n
       from orders o join sentiments s on s.submission_id = o.o_orderkey group by 1""", "sentiments"))
def _(t):
    lists = t.orders.select(F.col("o_orderkey").alias("submission_id"))
    counts = t.sentiments.groupBy("submission_id").agg(F.count("*").alias("n"))
    return lists.join(counts, "submission_id").where("n > 0")


# --------------------------------------------------------------- resolution

_WEIGHT_SQL = "case conviction " + " ".join(f"when '{k}' then {v}" for k, v in RESOLUTION_WEIGHTS.items()) + " else 1 end"
_VIEWS_SQL = f"""select {G}, sentiment, count(*) as n, sum(confidence) as conf, sum(sentiment_intensity) as inten,
 sum(confidence * sentiment_intensity) as ci, sum({_WEIGHT_SQL}) as conv, min(pos) as first_pos,
 bool_and(is_implicit) as is_implicit, count(distinct source) as n_sources, min(source) as src,
 min(confidence) as conf_min, max(confidence) as conf_max from pref group by {G}, sentiment"""
_SCORES = {"confidence_weighted": "conf", "majority_vote": "n", "intensity_weighted": "inten",
           "conviction_weighted": "conv"}


def _mode_sql(column):
    return f"""select {G}, sentiment, {column} as v from (select {G}, sentiment, {column},
     row_number() over (partition by {G}, sentiment order by count(*) desc, min(pos)) as rn
     from pref group by {G}, sentiment, {column}) where rn = 1"""


def _resolved_sql(strategy):
    if strategy == "highest_confidence":
        best = f"""select * from (select *, row_number() over (partition by {G} order by confidence desc, pos) as rn from pref) where rn = 1"""
        score_order = "conf_max desc, first_pos"
    else:
        best, score_order = None, f"{_SCORES[strategy]} desc, first_pos"
    ctes = dict(
        good=GOOD, pref=PREF, views=_VIEWS_SQL,
        ranked=f"""select *, row_number() over (partition by {G} order by {score_order}) as rn,
         count(*) over (partition by {G}) as kinds from views""",
        mp=_mode_sql("position"), mc=_mode_sql("conviction"), mh=_mode_sql("time_horizon"),
        merged=f"""select {G}, sentiment, kinds, cast(round_even(conf / n, 0) as int) as confidence,
         cast(round_even(ci / conf, 0) as int) as sentiment_intensity, is_implicit, mp.v as position,
         mc.v as conviction, mh.v as time_horizon, case when n_sources > 1 then 'both' else src end as source
         from ranked join mp using ({G}, sentiment) join mc using ({G}, sentiment) join mh using ({G}, sentiment)
         where rn = 1""",
        resolved=f"""select {G}, confidence, sentiment_intensity, is_implicit, sentiment, position, conviction,
         time_horizon, source from merged""",
    )
    if best:
        ctes.pop("resolved")
        ctes["best"] = best
        ctes["resolved"] = f"""select m.date, m.submission_id, m.ticker,
         case when kinds > 1 then b.confidence else m.confidence end as confidence,
         case when kinds > 1 then b.sentiment_intensity else m.sentiment_intensity end as sentiment_intensity,
         case when kinds > 1 then b.is_implicit else m.is_implicit end as is_implicit,
         case when kinds > 1 then b.sentiment else m.sentiment end as sentiment,
         case when kinds > 1 then b.position else m.position end as position,
         case when kinds > 1 then b.conviction else m.conviction end as conviction,
         case when kinds > 1 then b.time_horizon else m.time_horizon end as time_horizon,
         case when kinds > 1 then 'both' else m.source end as source
         from merged m join best b using ({G})"""
    return ctes


_RESOLVED_COLS = ["date", "submission_id", "ticker", "confidence", "sentiment_intensity", "is_implicit",
                  "sentiment", "position", "conviction", "time_horizon", "source"]
_ALL = f"select {DAY}, * exclude (date) from resolved"


def _register_strategy(key, strategy):
    @query(key, with_views(_ALL, "sentiments", **_resolved_sql(strategy)))
    def _(t):
        judged = X.judge_conflicts(t.sentiments, X.ConflictRules(strategy=strategy), dealt=True)
        return day(X.resolved_opinions(judged)).select(_RESOLVED_COLS)


_register_strategy("a10_highest_confidence", "highest_confidence")
_register_strategy("a11_confidence_weighted", "confidence_weighted")
_register_strategy("a12_majority_vote", "majority_vote")
_register_strategy("a13_intensity_weighted", "intensity_weighted")
_register_strategy("a14_conviction_weighted", "conviction_weighted")

CW = _resolved_sql("confidence_weighted")


@query("a15_group_merge", with_views(
    f"""select {DAY}, submission_id, ticker, confidence, sentiment_intensity, position, conviction, time_horizon,
        source, is_implicit from merged where kinds = 1""", "sentiments", **CW))
def _(t):
    judged = X.judge_conflicts(t.sentiments, dealt=True).where("n_kinds = 1")
    return day(X.resolved_opinions(judged)).select(
        "date", "submission_id", "ticker", "confidence", "sentiment_intensity", "position", "conviction",
        "time_horizon", "source", "is_implicit")


PRIMARY = f"""select date, submission_id, ticker as primary_ticker from (
 select *, row_number() over (partition by date, submission_id order by w desc, first_seen) as rn from (
  select {G}, sum(case when is_implicit then 1.0 else 1.5 end) as w, min(pos) as first_seen
  from sentiments where not extraction_refusal group by {G})
 where (date, submission_id) in (select (date, submission_id) from resolved)) where rn = 1"""


@query("a16_submission_dedup", with_views(
    f"""select {DAY}, submission_id, p.primary_ticker, count(*) as n_final, sum(confidence)::bigint as sum_confidence,
        string_agg(ticker || ':' || sentiment, ',' order by ticker) as opinions
        from resolved join primary_t p using (date, submission_id) group by date, submission_id, p.primary_ticker""",
    "sentiments", **CW, primary_t=PRIMARY))
def _(t):
    judged = X.judge_conflicts(t.sentiments, dealt=True)
    kept = F.col("winner").isNotNull()
    final = judged.groupBy("date", "submission_id").agg(
        F.sum(kept.cast("bigint")).alias("n_final"), F.sum("winner.confidence").alias("sum_confidence"),
        F.array_join(F.sort_array(F.collect_list(
            F.when(kept, F.concat("ticker", F.lit(":"), F.col("winner.sentiment"))))), ",").alias("opinions"))
    return day(final.where("n_final > 0").join(X.primary_tickers(judged), ["date", "submission_id"]))


@query("a17_primary_ticker", with_views(f"select {DAY}, submission_id, primary_ticker from primary_t",
                                        "sentiments", **CW, primary_t=PRIMARY))
def _(t):
    return day(X.primary_tickers(X.judge_conflicts(t.sentiments, dealt=True)))


@query("a17_primary_by_confidence", with_views(
    f"""select {DAY}, submission_id, ticker as primary_ticker from (select *, row_number() over (
        partition by date, submission_id order by confidence desc, first_seen) as rn from resolved join (
        select {G}, min(pos) as first_seen from sentiments where not extraction_refusal group by {G}) using ({G}))
        where rn = 1""", "sentiments", **CW))
def _(t):
    return day(X.primary_tickers(X.judge_conflicts(t.sentiments, dealt=True), by="highest_confidence"))


@query("a18_conflict_report", with_views(
    f"""select {DAY}, submission_id, ticker, c.n as conflict_count, c.spread as confidence_spread, c.levels as conviction_levels,
        r.sentiment as final_sentiment, r.conviction as final_conviction, r.confidence as final_confidence
        from resolved r join (select {G}, count(*) as n, max(confidence) - min(confidence) as spread,
          array_to_string(list_sort(list_distinct(list(conviction))), ',') as levels from pref group by {G} having count(*) > 1) c
        using ({G})""", "sentiments", **CW))
def _(t):
    report = X.conflict_report(X.judge_conflicts(t.sentiments, dealt=True))
    return day(report).select(
        "date", "submission_id", "ticker", "conflict_count", "confidence_spread",
        F.array_join(F.sort_array("conviction_levels"), ",").alias("conviction_levels"),
        "final_sentiment", "final_conviction", "final_confidence")


@query("a18_conflicting_opinions", with_views(
    f"""select {DAY}, submission_id, ticker, pos, sentiment, confidence from pref
        where ({G}) in (select ({G}) from pref group by {G} having count(*) > 1)""", "sentiments", good=GOOD, pref=PREF))
def _(t):
    s = t.sentiments
    return day(X.conflicting_opinions(s, X.judge_conflicts(s, dealt=True))).select(
        "date", "submission_id", "ticker", "pos", "sentiment", "confidence")


@query("a18_resolution_metrics", with_views(
    f"""select {DAY}, sum(n_all)::bigint as original_sentiments, sum(n_ref)::bigint as refusals_excluded,
        sum(n_imp)::bigint as implicit_found, sum((told > 0)::int)::bigint as tickers_found,
        sum((kept > 0)::int)::bigint as final_sentiments,
        sum(case when kept = 0 then told else 0 end)::bigint as sentiments_filtered,
        sum((kept > 0 and told > 1)::int)::bigint as conflicts_resolved,
        sum((coalesce(p.n, 0) > 1)::int)::bigint as conflicts_reported
        from (select {G}, count(*) as n_all, sum(extraction_refusal::int) as n_ref,
          sum((is_implicit and not extraction_refusal)::int) as n_imp, sum((not extraction_refusal)::int) as told,
          sum((not extraction_refusal and confidence >= 5 and sentiment_intensity >= 3)::int) as kept
          from sentiments group by {G}) left join (select {G}, count(*) as n from pref group by {G}) p using ({G})
        group by date""", "sentiments", good=GOOD, pref=PREF))
def _(t):
    return day(X.resolution_metrics(X.judge_conflicts(t.sentiments, dealt=True)))


# ---------------------------------------------------------------- consensus

_CW_LEVEL = "case conviction when 'low' then 1.0 when 'medium' then 2.0 when 'high' then 3.0 else 1.0 end"
CONS = f"""select r.date, r.ticker, count(*) as total_mentions, avg(confidence) as avg_confidence,
 avg(sentiment_intensity) as avg_sentiment_intensity, sum(confidence * sentiment_intensity) / sum(confidence) as cwi,
 sum((not is_implicit)::int)::bigint as explicit_mentions, sum(is_implicit::int)::bigint as implicit_mentions,
 min(submission_id) as first_seen,
 sum((sentiment = 'bullish')::int)::bigint as bull, sum((sentiment = 'bearish')::int)::bigint as bear,
 sum((sentiment = 'neutral')::int)::bigint as neut,
 sum(case when sentiment = 'bullish' then confidence * sentiment_intensity * {_CW_LEVEL} else 0 end)::double as bull_score,
 sum(case when sentiment = 'bearish' then confidence * sentiment_intensity * {_CW_LEVEL} else 0 end)::double as bear_score,
 coalesce(avg(({_CW_LEVEL})::double) filter (sentiment = 'bullish'), 0)::double as bull_conv,
 coalesce(avg(({_CW_LEVEL})::double) filter (sentiment = 'bearish'), 0)::double as bear_conv
 from resolved r group by r.date, r.ticker"""
CONS2 = """select *, case when bull > 0 and bear > 0 then least(least(bull, bear) / greatest(bull, bear)
 * ((bull_conv + bear_conv) / 6.0) * ((bull + bear) / total_mentions), 1.0) else 0.0 end as controversy,
 least(bull / total_mentions * (bear / total_mentions) * 4 * (1 - neut / total_mentions * 0.5), 1.0) as polarization from cons0"""
DOM = """select date, ticker, sentiment, n from (select date, ticker, sentiment, count(*) as n, row_number() over
 (partition by date, ticker order by count(*) desc, min(submission_id)) as rn from resolved group by date, ticker, sentiment) where rn = 1"""
CTE = dict(**CW, cons0=CONS, cons=CONS2)


def consensus(t) -> DataFrame:
    judged = X.judge_conflicts(t.sentiments, dealt=True)
    return C.daily_consensus(X.resolved_opinions(judged), X.primary_tickers(judged))


def light_consensus(t) -> DataFrame:
    """Without primary counts, for rankings that do not use them."""
    return C.daily_consensus(X.resolved_opinions(X.judge_conflicts(t.sentiments, dealt=True)))


@query("a01_consensus_core", with_views(
    f"""select {DAY}, ticker, total_mentions, round(avg_confidence, 6) as avg_confidence,
        round(avg_sentiment_intensity, 6) as avg_sentiment_intensity, round(cwi, 6) as confidence_weighted_intensity,
        explicit_mentions, implicit_mentions from cons""", "sentiments", **CTE))
def _(t):
    return core_columns(light_consensus(t))


def core_columns(consensus):
    out = rounded(day(consensus), "avg_confidence", "avg_sentiment_intensity", "confidence_weighted_intensity")
    return out.select("date", "ticker", "total_mentions", "avg_confidence", "avg_sentiment_intensity",
                      "confidence_weighted_intensity", "explicit_mentions", "implicit_mentions")


def _dist_sql():
    parts = [f"""select {DAY}, ticker, '{c}' as field, {c} as value, count(*)::double as n from resolved group by date, ticker, {c}"""
             for c in C.DISTRIBUTIONS]
    parts.append(f"""select {DAY}, ticker, 'confidence' as field, sentiment as value, round(avg(confidence), 6) as n
                     from resolved group by date, ticker, sentiment""")
    return " union all ".join(parts)


@query("a02_distributions", with_views(_dist_sql(), "sentiments", **CW))
def _(t):
    cons = day(light_consensus(t))
    maps = [(c, F.col(f"{c}_distribution").cast("map<string,double>")) for c in C.DISTRIBUTIONS]
    maps.append(("confidence", F.col("avg_confidence_by_sentiment")))
    tagged = F.array(*[
        F.struct(F.lit(name).alias("field"), F.map_entries(m).alias("entries")) for name, m in maps])
    return (cons.select("date", "ticker", F.inline(tagged))
            .select("date", "ticker", "field", F.inline("entries").alias("value", "n"))
            .withColumn("n", F.round("n", 6)))


@query("a03_conviction_scores", with_views(
    f"""select {DAY}, ticker, round(bull_score, 6) as bull_score, round(bear_score, 6) as bear_score,
        round(bull_conv, 6) as bull_conv, round(bear_conv, 6) as bear_conv from cons""", "sentiments", **CTE))
def _(t):
    return day(light_consensus(t)).select(
        "date", "ticker", F.round("conviction_weighted_bullish_score", 6).alias("bull_score"),
        F.round("conviction_weighted_bearish_score", 6).alias("bear_score"),
        F.round("avg_bullish_conviction", 6).alias("bull_conv"), F.round("avg_bearish_conviction", 6).alias("bear_conv"))


@query("a04_polarization", with_views(f"select {DAY}, ticker, round(polarization, 6) as polarization from cons",
                                      "sentiments", **CTE))
def _(t):
    return rounded(day(light_consensus(t)), "sentiment_polarization").select(
        "date", "ticker", F.col("sentiment_polarization").alias("polarization"))


@query("a05_controversy", with_views(
    f"select {DAY}, ticker, round(controversy, 6) as controversy, controversy > 0.6 as is_controversial from cons",
    "sentiments", **CTE))
def _(t):
    return day(light_consensus(t)).select(
        "date", "ticker", F.round("sentiment_controversy_score", 6).alias("controversy"), "is_controversial")


@query("a06_dominant_sentiment", with_views(
    f"""select {DAY}, ticker, d.sentiment as dominant_sentiment, round(d.n / total_mentions, 6) as strength,
        round(d.n / total_mentions * 100, 6) as pct from cons join dom d using (date, ticker)""",
    "sentiments", **CTE, dom=DOM))
def _(t):
    return day(light_consensus(t)).select(
        "date", "ticker", "dominant_sentiment", F.round("sentiment_consensus_strength", 6).alias("strength"),
        F.round("dominant_sentiment_percentage", 6).alias("pct"))


@query("a07_submission_counts", with_views(
    f"""select {DAY}, ticker, total_mentions as unique_submissions, coalesce(p.n, 0) as submissions_as_primary
        from cons left join (select date, primary_ticker as ticker, count(*) as n from primary_t group by 1, 2) p
        using (date, ticker)""", "sentiments", **CTE, primary_t=PRIMARY))
def _(t):
    return day(consensus(t)).select("date", "ticker", "unique_submissions", "submissions_as_primary")


@query("a07_distinct_submissions", with_views(
    f"""select {DAY}, ticker, count(distinct submission_id) as unique_submissions from sentiments
        where not extraction_refusal group by date, ticker""", "sentiments"))
def _(t):
    return day(C.submissions_per_ticker(t.sentiments))


@query("a08_day_totals", with_views(
    f"""select {DAY}, count(distinct submission_id) as total_submissions_processed, count(*) as total_sentiments_processed,
        count(distinct case when not extraction_refusal then ticker end) as unique_tickers
        from sentiments group by date""", "sentiments"))
def _(t):
    return day(C.day_totals(t.sentiments))


@query("a09_sentiment_overview", with_views(
    f"select {DAY}, sentiment, count(*) as n from resolved group by date, sentiment", "sentiments", **CW))
def _(t):
    return day(C.sentiment_overview(light_consensus(t)))


# ----------------------------------------------------------------- rankings

def _top_sql(select, where, order, limit=10, table="cons"):
    return with_views(
        f"""select {DAY}, cast(rank as int) as rank, ticker, {select} from (select *, row_number() over (partition by date
            order by {order}, first_seen, ticker) as rank from {table} where {where}) where rank <= {limit}""",
        "sentiments", **CTE)


@query("t01_most_mentioned", _top_sql("total_mentions", "true", "total_mentions desc"))
def _(t):
    return day(C.top_per_day(C.most_mentioned(light_consensus(t)), "total_mentions"))


def _weighted(side, s):
    return _top_sql(
        f"round({s}_score, 6) as score, round({s} / total_mentions * 100, 6) as pct, {s} as votes, total_mentions, round({s}_conv, 6) as avg_conviction",
        f"total_mentions >= 2 and {s} > 0", f"{s}_score desc, {s} / total_mentions * 100 desc")


@query("t02_weighted_bullish", _weighted("bullish", "bull"))
def _(t):
    top = C.top_per_day(C.conviction_weighted(light_consensus(t), "bullish"), "score", "pct")
    return rounded(day(top), "score", "pct", "avg_conviction")


@query("t03_weighted_bearish", _weighted("bearish", "bear"))
def _(t):
    top = C.top_per_day(C.conviction_weighted(light_consensus(t), "bearish"), "score", "pct")
    return rounded(day(top), "score", "pct", "avg_conviction")


def _most(s, extra="true"):
    return _top_sql(
        f"round({s} / total_mentions * 100, 6) as pct, {s} as votes, total_mentions, round(controversy, 6) as controversy",
        f"total_mentions >= 2 and {extra}", f"{s} / total_mentions * 100 desc, {s} desc")


@query("t04_most_bullish", _most("bull"))
def _(t):
    return rounded(day(C.top_per_day(C.most_of(light_consensus(t), "bullish"), "pct", "votes")), "pct", "controversy")


@query("t04_bullish_of_day", f"select * exclude (rank) from ({_most('bull')}) where date = '1996-03-05'")
def _(t):
    """One day's list: a pruned read and a top-k instead of a window."""
    rows = C.top_of_day(C.most_of(light_consensus(t), "bullish"), F.lit("1996-03-05").cast("date"), "pct", "votes")
    return rounded(day(rows), "pct", "controversy")


@query("t04_most_bullish_calm", _most("bull", "controversy <= 0.6"))
def _(t):
    calm = C.most_of(light_consensus(t), "bullish", exclude_controversial=True)
    return rounded(day(C.top_per_day(calm, "pct", "votes")), "pct", "controversy")


@query("t05_most_bearish", _most("bear"))
def _(t):
    return rounded(day(C.top_per_day(C.most_of(light_consensus(t), "bearish"), "pct", "votes")), "pct", "controversy")


@query("t06_most_controversial", _top_sql(
    """round(controversy, 6) as controversy, round(bull / total_mentions * 100, 6) as bullish_pct,
       round(bear / total_mentions * 100, 6) as bearish_pct, total_mentions""",
    "total_mentions >= 3", "controversy desc"))
def _(t):
    top = C.top_per_day(C.most_controversial(light_consensus(t)), "controversy")
    return rounded(day(top), "controversy", "bullish_pct", "bearish_pct")


def _clear(s, o):
    return _top_sql(
        f"round({s} / total_mentions * 100, 6) as pct, {s} as votes, total_mentions, round({o} / total_mentions * 100, 6) as other_pct",
        f"total_mentions >= 2 and {s} / total_mentions * 100 > 60 and {o} / total_mentions * 100 < 20",
        f"{s} / total_mentions * 100 desc")


@query("t07_clear_bullish", _clear("bull", "bear"))
def _(t):
    return rounded(day(C.top_per_day(C.clear_sentiment(light_consensus(t), "bullish"), "pct")), "pct", "other_pct")


@query("t08_clear_bearish", _clear("bear", "bull"))
def _(t):
    return rounded(day(C.top_per_day(C.clear_sentiment(light_consensus(t), "bearish"), "pct")), "pct", "other_pct")


_RANK_W = "case conviction when 'yolo' then 10 when 'high' then 8 when 'moderate' then 6 when 'low' then 4 when 'hedge' then 3 else 1 end"


@query("t09_highest_conviction", with_views(
    f"""select {DAY}, cast(rank as int) as rank, ticker, round(conviction, 6) as conviction, total_mentions from (
        select *, row_number() over (partition by date order by conviction desc, first_seen, ticker) as rank from (
         select date, ticker, sum({_RANK_W}) / count(*) as conviction, count(*) as total_mentions, min(submission_id) as first_seen
         from resolved group by date, ticker having count(*) >= 2)) where rank <= 10""", "sentiments", **CTE))
def _(t):
    return rounded(day(C.top_per_day(C.highest_conviction(light_consensus(t)), "conviction")), "conviction")


@query("t10_most_active", with_views(
    f"""select {DAY}, ticker, total_mentions from (select *, row_number() over (partition by date
        order by total_mentions desc, first_seen, ticker) as rank from cons) where rank = 1""", "sentiments", **CTE))
def _(t):
    return day(C.most_active_ticker(light_consensus(t)))


@query("t11_ticker_cards", with_views(
    f"""select {DAY}, ticker, total_mentions, coalesce(p.n, 0) as primary_ticker_count, d.sentiment as dominant,
        explicit_mentions || '/' || implicit_mentions as explicit_vs_implicit, round(polarization, 6) as polarization
        from cons join dom d using (date, ticker) left join (select date, primary_ticker as ticker, count(*) as n
        from primary_t group by 1, 2) p using (date, ticker)""", "sentiments", **CTE, dom=DOM, primary_t=PRIMARY))
def _(t):
    card = day(C.ticker_card(consensus(t)))
    return card.select(
        "date", "ticker", "total_mentions", "primary_ticker_count",
        F.substring_index("dominant_sentiment", " (", 1).alias("dominant"), "explicit_vs_implicit",
        F.round("polarization", 6).alias("polarization"))


def _list_sql(name, order, where="total_mentions >= 2"):
    return f"""select date, '{name}' as list, string_agg(ticker, ',' order by rank) as tickers from (select *, row_number() over
     (partition by date order by {order}, first_seen, ticker) as rank from cons where {where}) where rank <= 5 group by date"""


@query("t11_day_summary", with_views(
    f"select {DAY}, list, tickers from (" + " union all ".join([
        _list_sql("mentioned", "total_mentions desc", "true"),
        _list_sql("bullish", "bull / total_mentions * 100 desc, bull desc"),
        _list_sql("bearish", "bear / total_mentions * 100 desc, bear desc"),
        _list_sql("controversial", "controversy desc", "total_mentions >= 3")]) + ")", "sentiments", **CTE))
def _(t):
    cons = light_consensus(t)
    summary = C.day_summary(cons, {
        "mentioned": C.rank_mentioned(), "bullish": C.rank_side("bullish"), "bearish": C.rank_side("bearish"),
        "controversial": C.rank_controversial()})
    names = ["mentioned", "bullish", "bearish", "controversial"]
    tagged = F.array(*[F.struct(F.lit(n).alias("list"), F.array_join(F.col(f"{n}.ticker"), ",").alias("tickers")) for n in names])
    return day(summary).select("date", F.inline(tagged)).where("tickers <> ''")

"""Relevance features, training, evaluation and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as M, training as N
from tidemark.plans.registry import query
from tidemark.plans.views import with_views
from tidemark.session import scratch_path
from tidemark.sources import labels as L

# frequent short words stand in for ticker symbols, as the texts are invented
KNOWN = ("THE", "OF", "AND", "IT", "ON", "ALL")
_KNOWN_SQL = "[" + ", ".join(f"'{k}'" for k in KNOWN) + "]"

DOCS = """select submission_id, label, parts[1] as title, list_transform(parts, lambda p, i: case when length(p) % 4 = 0 then p else p || ' (score ' || (length(p) % 23 - 5) || ')' end) as comments from documents_doc"""
TEXTS = "select *, title || ' ' || array_to_string(comments, ' ') as txt, lower(title || ' ' || array_to_string(comments, ' ')) as low, lower(title) as lt from docs"


def docs_of(t):
    scored = F.transform("parts", lambda p: F.when(F.length(p) % 4 == 0, p).otherwise(
        F.concat(p, F.lit(" (score "), (F.length(p) % 23 - 5).cast("string"), F.lit(")"))))
    return t.documents_doc.select("submission_id", "label", F.try_element_at("parts", F.lit(1)).alias("title"), scored.alias("comments"))


def only(t, name, extractor, docs=None):
    docs = docs_of(t) if docs is None else docs
    out = M.extract(docs, {name: extractor})
    return out.select("submission_id", *[F.round(c, 6).alias(c) for c in out.columns if c not in docs.columns])


def oracle(columns, source="texts"):
    return with_views(f"select submission_id, {columns} from {source}", "documents_doc", docs=DOCS, texts=TEXTS)


_NW = "len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
_TOK = r"""list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: regexp_matches(w, '(^|[^\p{{L}}\p{{N}}_])[A-Za-z]{{1,5}}$')),
 lambda w: upper(regexp_extract(w, '([A-Za-z]{{1,5}})$', 1))), lambda w: list_contains({k}, w)))"""


@query("m01_ticker_features", with_views(
    f"""select submission_id, n::double as ticker_count, 0.0::double as explicit_ticker_count, (nt > 0)::int::double as ticker_in_title, round(n / greatest(w, 1) * 100, 6) as ticker_density, n::double as unique_tickers,
        round(nt / greatest(tw, 1), 6) as ticker_title_ratio from (select submission_id, len({_TOK.format(x='txt', k=_KNOWN_SQL)}) as n, len({_TOK.format(x='title', k=_KNOWN_SQL)}) as nt,
        {_NW.format(x='txt')} as w, {_NW.format(x='title')} as tw from texts)""", "documents_doc", docs=DOCS, texts=TEXTS))
def _(t):
    return only(t, "ticker", M.ticker_features(KNOWN))


@query("m02_thread_flags", with_views(
    "select submission_id, " + ", ".join(f"contains(lt, '{v}')::int::double as {k}" for k, v in M.THREAD_TITLES.items()) + " from flagged", "documents_doc",
    flagged="""select submission_id, lower(case submission_id % 4 when 0 then 'What Are Your Moves Tomorrow, ' when 1 then 'Daily Discussion Thread ' when 2 then 'Upcoming Earnings ' else '' end || parts[1]) as lt from documents_doc"""))
def _(t):
    k = F.col("submission_id") % 4
    head = F.when(k == 0, "What Are Your Moves Tomorrow, ").when(k == 1, "Daily Discussion Thread ").when(k == 2, "Upcoming Earnings ").otherwise("")
    out = M.extract(docs_of(t).withColumn("title", F.concat(head, "title")), {"threads": M.thread_flags})
    return out.select("submission_id", *out.columns[4:])


def _hits(x, words):
    return "(" + " + ".join(f"contains({x}, '{w}')::int" for w in words) + ")"


_ALL = (*M.HIGH_WORDS, *M.MEDIUM_WORDS, *M.LOW_WORDS)
# some words of the lists are put into the invented texts so that counts differ
_SEED = "case submission_id % 5 when 0 then 'buy the stock, price target and market news. should i worry, help me maybe? so sad! ' when 1 then 'LONG calls: Earnings growth; fear and doubt! how to HOLD? ' else '' end"
_SEEDED = f"select submission_id, label, {_SEED} || title as title, comments from docs0"


def seeded(t):
    k = F.col("submission_id") % 5
    head = (F.when(k == 0, "buy the stock, price target and market news. should i worry, help me maybe? so sad! ")
            .when(k == 1, "LONG calls: Earnings growth; fear and doubt! how to HOLD? ").otherwise(""))
    return docs_of(t).withColumn("title", F.concat(head, "title"))


def seeded_oracle(columns):
    return with_views(f"select submission_id, {columns} from texts", "documents_doc", docs0=DOCS, docs=_SEEDED, texts=TEXTS)


def seeded_only(t, name, extractor):
    out = M.extract(seeded(t), {name: extractor})
    return out.select("submission_id", *[F.round(c, 6).alias(c) for c in out.columns[4:]])


@query("m03_keyword_features", seeded_oracle(
    f"""{_hits('low', M.HIGH_WORDS)}::double as high_relevance_keywords, {_hits('low', M.MEDIUM_WORDS)}::double as medium_relevance_keywords, {_hits('low', M.LOW_WORDS)}::double as low_relevance_keywords,
        {_hits('low', _ALL)}::double as total_keyword_count, round({_hits('low', _ALL)} / greatest({_NW.format(x='txt')}, 1) * 100, 6) as keyword_density, {_hits('lt', _ALL)}::double as title_keyword_count,
        round({_hits('lt', _ALL)} / greatest({_NW.format(x='title')}, 1) * 100, 6) as title_keyword_density, round({_hits('low', _ALL)} / {len(set(_ALL))}, 6) as unique_keyword_ratio"""))
def _(t):
    return seeded_only(t, "keyword", M.keyword_features)


@query("m04_psychology_features", seeded_oracle(
    f"""{_hits('low', M.PSYCHOLOGY_WORDS)}::double as psychology_keyword_count, {_hits('low', M.ADVICE_PHRASES)}::double as advice_pattern_count, (length(low) - length(replace(low, '?', '')))::double as question_count,
        {_hits('low', M.HELP_WORDS)}::double as help_seeking_count, {_hits('low', M.UNCERTAIN_WORDS)}::double as uncertainty_indicators, {_hits('low', M.EMOTION_WORDS)}::double as emotional_language_count"""))
def _(t):
    return seeded_only(t, "psychology", M.psychology_features)


_CL = "list_sum(list_transform(comments, lambda c: length(c)))"


@query("m05_structure_features", oracle(
    f"""length(title)::double as title_length, (length(title) + {_CL})::double as total_text_length, len(comments)::double as comment_count, round({_CL} / greatest(len(comments), 1), 6) as avg_comment_length,
        (submission_id % 97 - 11)::double as submission_score, {_NW.format(x='title')}::double as title_word_count, round((length(title) + {_CL}) / greatest(length(title), 1), 6) as text_to_title_ratio, starts_with(comments[1], 'Submission body:')::int::double as has_submission_body"""))
def _(t):
    return only(t, "structure", M.structure_features(with_score=True), docs=docs_of(t).withColumn("original_score", F.col("submission_id") % 97 - 11))


_SC = r"list_transform(list_filter(comments, lambda c: regexp_matches(c, '\(score -?\d+\)')), lambda c: cast(regexp_extract(c, '\(score (-?\d+)\)', 1) as bigint))"


@query("m06_engagement_features", with_views(
    """select submission_id, round(coalesce(list_avg(s), 0), 6) as avg_comment_score, coalesce(list_max(s), 0)::double as max_comment_score, coalesce(list_min(s), 0)::double as min_comment_score,
        len(list_filter(s, lambda v: v >= 5))::double as high_score_comments, len(list_filter(s, lambda v: v < 0))::double as negative_score_comments, round(coalesce(list_var_pop(s), 0), 6) as score_variance,
        coalesce(list_max(s) - list_min(s), 0)::double as score_range, round(coalesce(len(list_filter(s, lambda v: v > 0)) / nullif(len(s), 0), 0), 6) as positive_engagement_ratio from sc""",
    "documents_doc", docs=DOCS, sc=f"select submission_id, {_SC} as s from docs"))
def _(t):
    return only(t, "engagement", M.engagement_features)


_W = r"list_filter(regexp_split_to_array(txt, '\s+'), lambda w: w <> '')"


@query("m07_quality_features", with_views(
    r"""select submission_id, round(len(regexp_extract_all(txt, '\p{Lu}')) / length(txt), 6) as uppercase_ratio, round(len(regexp_extract_all(txt, '[.,!?;:]')) / length(txt), 6) as punctuation_density,
        round(list_sum(list_transform(w, lambda x: length(x))) / greatest(len(w), 1), 6) as avg_word_length, round(len(list_distinct(w)) / greatest(len(w), 1), 6) as unique_word_ratio, ns::double as sentence_count,
        round(length(txt) / greatest(ns, 1), 6) as avg_sentence_length, (length(txt) - length(replace(txt, '!', '')))::double as exclamation_count,
        len(list_filter(w, lambda x: length(x) > 1 and regexp_matches(x, '\p{Lu}') and not regexp_matches(x, '\p{Ll}')))::double as caps_word_count
        from (select *, """ + _W + r""" as w, len(list_filter(regexp_split_to_array(txt, '[.!?]+'), lambda s: regexp_matches(s, '\S'))) as ns from texts)""", "documents_doc", docs=DOCS, texts=TEXTS))
def _(t):
    return only(t, "quality", M.quality_features)


@query("m08_feature_vectors", oracle(
    f"""50 as n_features, length(title)::double as title_length, len(comments)::double as comment_count, 0.0::double as submission_score"""))
def _(t):
    from pyspark.ml.functions import vector_to_array

    names = M.feature_names()
    v = vector_to_array(F.col("features"))
    out = M.assemble(M.extract(docs_of(t)), names)
    return out.select("submission_id", F.size(v).alias("n_features"), *[v[names.index(n)].alias(n) for n in ("title_length", "comment_count", "submission_score")])


@query("m09_token_windows", with_views(
    f"""select doc_id, count(*) as n_windows, sum(least(64, n - s))::bigint as n_tokens from (select doc_id, n, unnest(range(0, n, 16)) as s from (select doc_id, {_NW.format(x='text')} as n from documents)) group by doc_id"""))
def _(t):
    windows = M.token_windows(t.documents.select("doc_id", "text"), F.col("text"), length=64, stride=16)
    return windows.groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.sum(F.size("window")).alias("n_tokens"))


@query("m09_mean_pooling", "select label, i::int as i, round(avg(v), 5) as v, count(*) as n_windows from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by 1, 2")
def _(t):
    pooled = M.mean_pool(t.embeddings, "label", "embedding")
    return pooled.select("label", "n_windows", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.round("v", 5))


def _toy_encoder():
    return lambda texts: [[float(len(s)), float(s.count(" ") + 1)] for s in texts]


@query("u03_encoder_hook", with_views(
    rf"""select doc_id, round(avg(len(array_to_string(w, ' '))), 4) as chars, round(avg(len(w)), 4) as tokens from (select doc_id, tok[s + 1:s + 256] as w from (select doc_id, tok, unnest(range(0, len(tok), 64)) as s from
        (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as tok from documents))) group by doc_id"""))
def _(t):
    windows = M.encode_windows(M.token_windows(t.documents.select("doc_id", "text"), F.col("text")), _toy_encoder)
    pooled = M.mean_pool(windows, "doc_id", "vector")
    return pooled.select("doc_id", F.round(F.col("vector")[0], 4).alias("chars"), F.round(F.col("vector")[1], 4).alias("tokens"))


@query("u01_custom_extractor", oracle("length(txt)::double as n_chars, len(comments)::double as n_parts"))
def _(t):
    mine = lambda: {"n_chars": F.length(M.all_text()), "n_parts": F.size(M.comments())}
    out = M.extract(docs_of(t), {"mine": mine})
    return out.select("submission_id", "n_chars", "n_parts")


@query("u02_prescorer_hook", "select doc_id from documents where length(text) % 2 = 0 union all select -1 - doc_id from documents")
def _(t):
    @F.pandas_udf("boolean")
    def even(s):
        return s.str.len() % 2 == 0

    kept = M.prescore(t.documents, even("text")).select("doc_id")
    return kept.unionByName(M.prescore(t.documents).select((-1 - F.col("doc_id")).alias("doc_id")))


# ----------------------------------------------------------------- training

NAMES = ("title_length", "total_text_length", "comment_count", "avg_comment_length", "title_word_count", "text_to_title_ratio")


def feature_table(t):
    return M.extract(docs_of(t).where("label is not null"), {"structure": M.structure_features(), "quality": M.quality_features, "keyword": M.keyword_features})


_FT = f"""select submission_id, label, length(title)::double as title_length, (length(title) + {_CL})::double as total_text_length, len(comments)::double as comment_count, {_CL} / greatest(len(comments), 1) as avg_comment_length,
 {_NW.format(x='title')}::double as title_word_count, (length(title) + {_CL}) / greatest(length(title), 1) as text_to_title_ratio from docs where label is not null"""
_SPLIT = "select *, rn <= floor(n * 0.2 + 0.5) as is_test from (select *, row_number() over (partition by label order by md5(submission_id || ':42'), submission_id) as rn, count(*) over (partition by label) as n from labelled)"


@query("a25_training_summary", with_views(
    """select count(*) as total_samples, sum(label)::bigint as positive_samples, (count(*) - sum(label))::bigint as negative_samples, round(avg(label), 6) as class_balance, 'batch,expert,manual' as labelers,
        round(avg(confidence), 6) as avg_confidence, 2 as feature_count, substr(md5('[''a'', ''b'']'), 1, 8) as featurizer_hash from labelled""", "labelled"))
def _(t):
    out = L.training_summary(t.labelled, ["a", "b"])
    return out.withColumns({c: F.round(c, 6) for c in ("class_balance", "avg_confidence")})


@query("m10_scaling_stats", with_views(
    " union all ".join(f"select '{n}' as feature, round(avg({n}), 6) as mean, round(stddev_pop({n}), 6) as std from ft" for n in NAMES), "documents_doc", docs=DOCS, ft=_FT))
def _(t):
    out = N.column_stats(feature_table(t), list(NAMES))
    return out.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("m11_stratified_split", with_views("select submission_id, label, is_test from s", "labelled", s=_SPLIT))
def _(t):
    return N.stratified_split(t.labelled.select("submission_id", "label"))


@query("m11_stratified_folds", with_views("select submission_id, ((rn - 1) % 5)::int as fold from s", "labelled", s=_SPLIT))
def _(t):
    return N.stratified_folds(t.labelled.select("submission_id", "label")).select("submission_id", "fold")


def _fitted(t, kind="logistic_regression", **params):
    names = list(NAMES)
    split = N.stratified_split(M.assemble(feature_table(t).select("submission_id", "label", *names), names))
    train, test = split.where("not is_test"), split.where("is_test")
    scaler = N.fit_scaler(train)
    model = N.make_classifier(kind, **params).fit(scaler.transform(train))
    return names, scaler, model, train, test


@query("m12_logistic_regression")
def _(t):
    _n, scaler, model, _train, test = _fitted(t, regParam=0.01)
    return N.score(scaler.transform(test), model)


@query("m12_fit_certificate", with_views(
    " union all ".join(f"select '{n}' as feature, round(avg(label * coalesce(({n} - m) / nullif(sd, 0), 0)), 4) + 0.0 as moment, 0.0 as gradient from (select label, {n}, avg({n}) over () as m, stddev_pop({n}) over () as sd from tr)"
                       for n in NAMES) + " union all select 'intercept', round(avg(label), 4) + 0.0, 0.0 from tr",
    "documents_doc", "labelled", docs=DOCS, ft=_FT, s=_SPLIT, tr="select ft.* from ft join s using (submission_id) where not s.is_test"))
def _(t):
    """The moments that the fitted weights imply; SQL takes them from the labels, and both agree only at the optimum."""
    names, scaler, model, train, _test = _fitted(t, regParam=0.01, tol=1e-12, maxIter=1000)
    found = N.fit_certificate(scaler.transform(train), model, names)
    return found.select("feature", (F.round("implied", 4) + 0.0).alias("moment"), F.abs(F.round("gradient", 4)).alias("gradient"))


@query("m12_random_forest")
def _(t):
    _n, scaler, model, _train, test = _fitted(t, "random_forest", numTrees=10, seed=42)
    return N.score(scaler.transform(test), model)


@query("m13_grid_search")
def _(t):
    names, scaler, _model, train, _test = _fitted(t, regParam=0.01)
    cv = N.cross_validate(scaler.transform(train), N.make_classifier(maxIter=20), {"regParam": [0.01, 0.1]}, folds=3)
    return t.spark.createDataFrame(N.grid_scores(cv), "params string, mean double, std double")


@query("m15_feature_importance")
def _(t):
    names, _s, model, _train, _test = _fitted(t, regParam=0.01)
    return N.top_features(N.feature_importance(t.spark, model, names))


@query("m16_batch_scoring")
def _(t):
    names, scaler, model, _train, _test = _fitted(t, regParam=0.01)
    docs = M.extract(docs_of(t), {"structure": M.structure_features()})
    error = F.when(F.col("title").isNull(), F.lit("no title"))
    return N.score(scaler.transform(M.assemble(docs, names)), model, error=error)


_PRED = "select d.submission_id, p.probability_relevant, p.predicted_label, d.label from predictions p join labelled d using (submission_id)"


def _judged(t):
    return t.predictions.join(t.labelled.select("submission_id", "label"), "submission_id")


@query("m14_confusion", with_views("select label, predicted_label, count(*) as n from j group by 1, 2", "predictions", "labelled", j=_PRED))
def _(t):
    return N.confusion(_judged(t))


@query("m14_class_report", with_views(
    """select class, round(coalesce(tp / nullif(pp, 0), 0), 6) as precision, round(coalesce(tp / nullif(sp, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(pp + sp, 0), 0), 6) as f1, sp as support from (
        select c as class, (select count(*) from j where label = c and predicted_label = c) as tp, (select count(*) from j where predicted_label = c) as pp, (select count(*) from j where label = c) as sp from (select unnest([0, 1]) as c))""",
    "predictions", "labelled", j=_PRED))
def _(t):
    out = N.class_report(_judged(t))
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("m14_accuracy", with_views("select round(avg((label = predicted_label)::int), 6) as accuracy from j", "predictions", "labelled", j=_PRED))
def _(t):
    return N.accuracy(_judged(t)).withColumn("accuracy", F.round("accuracy", 6))


@query("m14_ranking_metrics", with_views(
    """select round(sum(neg * (tp - pos + pos * 0.5)) / (sum(pos) * sum(neg)), 6) as roc_auc, round(sum(pos * (tp / (tp + fp) + coalesce((tp - pos) / nullif(tp + fp - pos - neg, 0), 1.0)) / 2) / sum(pos), 6) as pr_auc from (
        select *, sum(pos) over (order by s desc) as tp, sum(neg) over (order by s desc) as fp from (select probability_relevant as s, sum(label)::double as pos, sum(1 - label)::double as neg from j group by 1))""",
    "predictions", "labelled", j=_PRED))
def _(t):
    out = N.ranking_metrics(_judged(t))
    return out.select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


@query("s22_feature_store", with_views("select submission_id, label, title_length, comment_count from ft", "documents_doc", docs=DOCS, ft=_FT))
def _(t):
    path = scratch_path(t.spark, "features")
    N.save_features(feature_table(t), path, list(NAMES))
    back, names = N.load_features(t.spark, path)
    N.check_same_features(names, list(NAMES))
    return back.select("submission_id", "label", "title_length", "comment_count")

"""Stores, requests, labels, costs and bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import costs as K, predictions as P
from tidemark.plans.registry import query
from tidemark.plans.views import with_views
from tidemark.session import scratch_path
from tidemark.sources import (
    consensus_store as CS, documents as S, dump as U, labels as L, prices as PR, requests as R,
    results_store as RS,
)

TEMPLATE = "Title: {title}\nBody: {body}\nComments: {comment}"
SYSTEM_TOKENS = 120
MODEL = "gpt-4.1-mini"


# ---------------------------------------------------------------- dump, files

@query("s01_dump_scan", """select count(*) as lines, count(case when doc_id % 50 = 7 then 1 end) as bad_lines,
 count(case when doc_id % 50 <> 7 then 1 end) as with_id from documents""")
def _(t):
    path = scratch_path(t.spark, "dump")
    good = F.to_json(F.struct(*[c for c in t.dump_lines.columns]))
    # a cut line, as a broken transfer leaves it
    line = F.when(F.expr("substring(id, 2)").cast("bigint") % 50 == 7, F.substring(good, 1, 20)).otherwise(good)
    t.dump_lines.select(line.alias("value")).write.option("compression", "gzip").text(path)
    return U.count_bad_lines(U.read_dump(t.spark, path))


@query("s01_zst_dump_scan", """select count(*) as lines, count(case when doc_id % 50 = 7 then 1 end) as bad_lines,
 count(case when doc_id % 50 <> 7 then 1 end) as with_id from documents""")
def _(t):
    path = scratch_path(t.spark, "zst")
    good = F.to_json(F.struct(*[c for c in t.dump_lines.columns]))
    line = F.when(F.expr("substring(id, 2)").cast("bigint") % 50 == 7, F.substring(good, 1, 20)).otherwise(good)

    def compress(batches):
        import uuid

        import pandas as pd
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        store.create_dir(root, recursive=True)
        for batch in batches:
            name = f"{root}/{uuid.uuid4().hex}.zst"
            with store.open_output_stream(name, compression=None) as out:
                out.write(zstandard.compress("".join(v + "\n" for v in batch["value"]).encode()))
            yield pd.DataFrame({"path": [name]})

    made = t.dump_lines.select(line.alias("value")).mapInPandas(compress, "path string")
    # file names only; one per written file
    return U.count_bad_lines(U.read_zst_dump(t.spark, [r.path for r in made.collect()]))


@query("s03_csv_scan", with_views("""select subreddit, count(*) as n, sum(score)::bigint as total_score, sum(length(text))::bigint as size
 from csv_submissions group by subreddit""", "csv_submissions"))
def _(t):
    path = scratch_path(t.spark, "csv")
    rows = t.csv_submissions.withColumn("name", F.concat("subreddit", F.lit("_submissions")))
    columns = ["author", "title", "score", "created", "link", "text", "url"]
    rows.select(*columns, "name").write.options(header=True, quote='"', escape='"').partitionBy("name").csv(path)
    got = U.read_csv_dump(t.spark, f"{path}/*", "submission")
    return got.groupBy("subreddit").agg(F.count("*").alias("n"), F.sum("score").alias("total_score"),
                                        F.sum(F.length("text")).alias("size"))


@query("s04_document_sink", with_views("""select subreddit, coalesce(strftime(try_strptime(created, '%Y-%m-%d %H:%M'), '%Y%m%d'), 'unknown_date') as day,
 count(*) as n from csv_submissions group by 1, 2""", "csv_submissions"))
def _(t):
    path = scratch_path(t.spark, "docs")
    docs = t.csv_submissions.select(
        F.regexp_extract("link", r"/comments/(\d+)/", 1).alias("submission_id"), "title", F.col("created").alias("date"),
        "subreddit", F.array("text").alias("comments"), "created")
    S.write_documents(docs.drop("created").withColumn("created", F.col("date")), path, F.col("created"))
    back = S.read_documents(t.spark, path)
    return back.groupBy(F.col("sub").alias("subreddit"), "day").agg(F.count("*").alias("n"))


_WIDE_TICKERS = [f"T{i:02d}" for i in range(10)]


@query("s07_price_panel", with_views("select ticker, cast(date as varchar) as date, round(close, 4) as close, volume::double as volume from prices", "prices"))
def _(t):
    wide = t.prices.groupBy("date").pivot("ticker", _WIDE_TICKERS).agg(
        F.first("close").alias("Close"), F.first("volume").alias("Volume"))
    wide = wide.select("date", *[F.col(c).alias(c.replace("_", "|")) for c in wide.columns if c != "date"])
    return PR.normalise_panel(wide).select("ticker", F.col("date").cast("string").alias("date"), F.round("close", 4).alias("close"), "volume")


@query("s08_panel_sink", with_views("""select ticker, count(*) as n, round(sum(close), 2) as total, f from prices, (select unnest(['parquet', 'csv']) as f)
 group by ticker, f""", "prices"))
def _(t):
    out = []
    for fmt in ("parquet", "csv"):
        path = scratch_path(t.spark, "panel")
        PR.write_panel(t.prices.select("ticker", "date", "close"), path, fmt)
        reader = t.spark.read.schema("ticker string, date date, close double")
        back = reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
        out.append(back.groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("total")).withColumn("f", F.lit(fmt)))
    return out[0].unionByName(out[1])


@query("a32_panel_summary", with_views("""select count(*) as total_rows, count(distinct ticker) as unique_tickers, cast(min(date) as varchar) as first_date,
 cast(max(date) as varchar) as last_date from prices""", "prices"))
def _(t):
    out = PR.panel_summary(t.prices)
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query("x04_concat_batches", with_views("select ticker, cast(date as varchar) as date, volume from prices", "prices"))
def _(t):
    p = t.prices.select("ticker", F.col("date").cast("string").alias("date"), "volume")
    return PR.concat_batches([p.where("volume <= 100"), p.where("volume between 101 and 200"), p.where("volume > 200")])


@query("f13_ticker_universe", """select p_partkey, symbol, exchange from (select p_partkey, case when p_partkey % 5 = 0 then p_type else substr(replace(p_type, ' ', ''), 1, 1 + p_partkey % 7) end as symbol,
 case p_partkey % 4 when 0 then 'NASDAQ' when 1 then 'NYSE' when 2 then 'AMEX' else 'LSE' end as exchange from part)
 where exchange in ('NASDAQ', 'NYSE', 'AMEX') and regexp_matches(symbol, '^[A-Za-z]{1,5}$')""")
def _(t):
    k = F.col("p_partkey") % 4
    symbols = t.part.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(
            F.substring(F.replace("p_type", F.lit(" "), F.lit("")), F.lit(1), (1 + F.col("p_partkey") % 7).cast("int"))).alias("symbol"),
        F.when(k == 0, "NASDAQ").when(k == 1, "NYSE").when(k == 2, "AMEX").otherwise("LSE").alias("exchange"))
    return PR.ticker_universe(symbols)


# ------------------------------------------------------------ consensus store

DAILY = "select date, ticker, count(*) as mentions, sum(confidence)::bigint as conf from sentiments group by date, ticker"
_OUT = "cast(date as varchar) as date, ticker, mentions, conf"


def daily(t):
    return t.sentiments.groupBy("date", "ticker").agg(F.count("*").alias("mentions"), F.sum("confidence").alias("conf"))


def shown(df):
    return df.withColumn("date", F.col("date").cast("string"))


_WRITTEN: dict[tuple, str] = {}


def day_store(t):
    """The daily table written by day, once per session and folder, and read back."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _WRITTEN:
        path = scratch_path(t.spark, "store")
        CS.write_days(daily(t), path)
        _WRITTEN[key] = path
    return CS.read_store(t.spark, _WRITTEN[key])


@query("s10_store_overwrite_days", with_views(
    f"select {_OUT} from (select date, ticker, case when year(date) = 1996 then mentions * 10 else mentions end as mentions, conf from daily)",
    "sentiments", daily=DAILY))
def _(t):
    path = scratch_path(t.spark, "store")
    rows = daily(t)
    CS.write_days(rows, path)
    CS.write_days(rows.where(F.year("date") == 1996).withColumn("mentions", F.col("mentions") * 10), path)
    return shown(CS.read_store(t.spark, path))


@query("s11_load_day", with_views(f"select {_OUT} from daily where date = date '1997-05-28'", "sentiments", daily=DAILY))
def _(t):
    return shown(CS.load_day(day_store(t), F.lit("1997-05-28").cast("date")))


@query("s12_ticker_history", with_views(f"select {_OUT} from daily where ticker = 'T03' and date between date '1996-01-01' and date '1997-12-31'", "sentiments", daily=DAILY))
def _(t):
    lo, hi = F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date")
    return shown(CS.ticker_history(day_store(t), "T03", lo, hi))


@query("s13_available_dates", with_views("select cast(date as varchar) as date from daily group by 1", "sentiments", daily=DAILY))
def _(t):
    return shown(CS.available_dates(day_store(t)))


@query("s13_date_range", with_views("select cast(min(date) as varchar) as first_date, cast(max(date) as varchar) as last_date from daily", "sentiments", daily=DAILY))
def _(t):
    out = CS.date_range(day_store(t))
    return out.select(*[F.col(c).cast("string").alias(c) for c in out.columns])


@query("s14_store_stats", with_views(
    """select count(*) as total_dates, round(avg(n), 6) as avg_tickers_per_day, (select count(distinct ticker) from daily) as total_tickers
       from (select date, count(*) as n from daily group by date)""", "sentiments", daily=DAILY))
def _(t):
    return CS.store_stats(day_store(t)).select(
        "total_dates", F.round("avg_tickers_per_day", 6).alias("avg_tickers_per_day"), "total_tickers")


@query("s14_stored_bytes", with_views("select count(distinct date) as n_files, true as more_than_values from daily", "sentiments", daily=DAILY))
def _(t):
    """One file per day, and more bytes than a byte per stored value."""
    store = day_store(t)
    counts = store.groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("n_files"), F.sum("n").alias("rows"))
    long = counts.unionByName(CS.stored_bytes(store), allowMissingColumns=True)
    return long.agg(*[F.max(c).alias(c) for c in long.columns]).select("n_files", (F.col("bytes") > 3 * F.col("rows")).alias("more_than_values"))


@query("s15_two_stores", with_views(
    f"""select {_OUT} from (select date, ticker, mentions + 1 as mentions, conf from daily where year(date) >= 1999
        union all select * from daily where year(date) < 1999)""", "sentiments", daily=DAILY))
def _(t):
    both = daily(t)
    recent = both.where(F.year("date") >= 1999).withColumn("mentions", F.col("mentions") + 1)
    return shown(CS.two_stores(recent, both))


@query("x01_all_dates", with_views("select distinct cast(date as varchar) as date from daily where year(date) <> 1997", "sentiments", daily=DAILY))
def _(t):
    d = t.sentiments
    return shown(CS.all_dates(d.where(F.year("date") >= 1998), d.where(F.year("date") < 1997)))


@query("s16_retention", with_views(f"select {_OUT} from daily where date >= date '1999-06-30' - 30", "sentiments", daily=DAILY))
def _(t):
    return shown(CS.retained(day_store(t), F.lit("1999-06-30").cast("date"), 30))


# ------------------------------------------------------------- results, log

RESULTS = """select cast(cast(o_orderdate as date) as varchar) as date, o_orderkey as submission_id, o_custkey % 7 as extraction_count,
 case when o_orderstatus = 'P' then 'timeout' end as error, o_orderkey as ts from orders"""


def results(t):
    return t.orders.select(
        F.col("o_orderdate").cast("date").cast("string").alias("date"), F.col("o_orderkey").alias("submission_id"),
        (F.col("o_custkey") % 7).alias("extraction_count"), F.when(F.col("o_orderstatus") == "P", "timeout").alias("error"),
        F.col("o_orderkey").alias("ts"))


@query("s17_upsert_results", with_views(
    """select date, count(*) as total_submissions, sum(case when submission_id % 4 = 0 then extraction_count + 5 else extraction_count end)::bigint as total_extractions
       from r group by date""", r=RESULTS))
def _(t):
    old = results(t)
    new = old.where("submission_id % 4 = 0").withColumns({"extraction_count": F.col("extraction_count") + 5, "ts": F.col("ts") + 1_000_000_000})
    stale = new.withColumns({"extraction_count": F.lit(0).cast("bigint"), "ts": F.lit(-1).cast("bigint")})
    return RS.result_totals(RS.upsert(old, new.unionByName(stale), ["date", "submission_id"]))


@query("s18_consolidate_day", with_views(
    """select date, count(case when error is null then 1 end) as successful_results, count(error) as failed_results, count(*) as total_results,
        coalesce(sum(case when error is null then extraction_count end), 0)::bigint as total_extractions from r group by date""", r=RESULTS))
def _(t):
    return RS.consolidation_totals(results(t))


@query("s19_find_submissions", """select c_custkey as submission_id, count(o_orderkey) > 0 as found, count(o_orderkey) as n
 from customer left join orders on o_orderkey = c_custkey * 11 group by 1""")
def _(t):
    docs = t.orders.select(F.col("o_orderkey").alias("key"))
    ids = t.customer.select((F.col("c_custkey") * 11).alias("key"))
    found, lost = RS.find(docs, ids, "key")
    one = found.groupBy("key").agg(F.count("*").alias("n")).withColumn("found", F.lit(True))
    none = lost.select("key", F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("found"))
    return one.unionByName(none).select((F.col("key") / 11).cast("bigint").alias("submission_id"), "found", "n")


_INV = """select date, count(case when s = 'i' then 1 end) > 0 as has_incremental, count(case when s = 'i' then 1 end) as incremental_count,
 count(case when s = 'c' then 1 end) > 0 as has_consolidated, count(case when s = 'p' then 1 end) > 0 as has_checkpoint from (
 select date, 'i' as s from r where submission_id % 3 = 0 union all select date, 'c' from r where submission_id % 5 = 0 group by date
 union all select date, 'p' from processing_log where status = 'failed') group by date"""


def _inventory(t):
    r = results(t)
    return RS.inventory(r.where("submission_id % 3 = 0"), r.where("submission_id % 5 = 0").select("date").distinct(),
                        t.processing_log.where("status = 'failed'"))


@query("s20_store_inventory", with_views(_INV, "processing_log", r=RESULTS))
def _(t):
    return _inventory(t)


@query("s20_inventory_totals", with_views(
    """select count(*) as total_dates, sum(incremental_count)::bigint as total_incremental, sum(has_consolidated::int)::bigint as consolidated_dates,
        sum(has_checkpoint::int)::bigint as checkpoint_dates from inv""", "processing_log", r=RESULTS, inv=_INV))
def _(t):
    return RS.inventory_totals(_inventory(t))


def _ids(t):
    return t.orders.select(F.col("o_orderdate").cast("date").cast("string").alias("date"), F.col("o_orderkey").alias("submission_id"))


@query("j03_unprocessed", with_views("select o_orderkey as submission_id from orders where o_orderkey not in (select submission_id from processing_log where status in ('processed', 'failed'))", "processing_log"))
def _(t):
    return RS.to_do(_ids(t), t.processing_log).select("submission_id")


@query("x02_to_do_with_retry", with_views("select o_orderkey as submission_id from orders where o_orderkey not in (select submission_id from processing_log where status = 'processed')", "processing_log"))
def _(t):
    return RS.to_do(_ids(t), t.processing_log, retry_failed=True).select("submission_id")


@query("x03_retry_subset", with_views("select submission_id, session_id from processing_log where status = 'failed' and submission_id in (select o_orderkey from orders where o_custkey % 2 = 0)", "processing_log"))
def _(t):
    wanted = t.orders.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("submission_id"))
    return RS.retry_subset(t.processing_log, wanted).select("submission_id", "session_id")


@query("a29_progress", with_views(
    """select date, total_found, processed, failed, skipped, total_found - processed - failed - skipped as remaining,
        round((processed + failed) / total_found, 6) as completion_rate, round(coalesce(processed / nullif(processed + failed, 0), 0), 6) as success_rate,
        total_found = processed + failed + skipped as is_complete from (select a.date, count(*) as total_found, count(case when status = 'processed' then 1 end) as processed,
        count(case when status = 'failed' then 1 end) as failed, count(case when status = 'skipped' then 1 end) as skipped
        from r a left join processing_log l using (submission_id) group by a.date)""", "processing_log", r=RESULTS))
def _(t):
    out = RS.progress(_ids(t), t.processing_log)
    return out.withColumns({c: F.round(c, 6) for c in ("completion_rate", "success_rate")})


@query("a29_sessions", with_views("""select session_id, count(case when status = 'processed' then 1 end) as processed_count,
 count(case when status = 'failed' then 1 end) as failed_count, max(ts) as last_activity from processing_log group by session_id""", "processing_log"))
def _(t):
    return RS.sessions(t.processing_log)


@query("a30_run_summary", """select source as subreddit, count(case when doc_id % 5 not in (0, 1) then 1 end) as processed, count(case when doc_id % 5 = 1 then 1 end) as skipped_runs,
 count(case when doc_id % 5 = 0 then 1 end) as failed, round(coalesce(avg(case when doc_id % 5 not in (0, 1) then n_chars / 100 end), 0), 6) as avg_seconds,
 sum(case when doc_id % 5 not in (0, 1) then n_chars % 40 else 0 end)::bigint as total_comments from documents group by source""")
def _(t):
    k = F.col("doc_id") % 5
    runs = t.documents.select(F.col("source").alias("subreddit"), (k != 0).alias("success"), (k == 1).alias("skipped"),
                              (F.col("n_chars") / 100).alias("seconds"), (F.col("n_chars") % 40).alias("n_comments"))
    return RS.run_summary(runs).withColumn("avg_seconds", F.round("avg_seconds", 6))


# ------------------------------------------------------------------- labels

@query("s21_label_import", """select doc_id as submission_id, quality as label, case when doc_id % 2 = 0 then 'expert' else 'file_import' end as labeler,
 case when doc_id % 3 = 0 then 4.5 else 5.0 end::double as confidence, '' as notes from labels""")
def _(t):
    raw = t.labels.select(F.col("doc_id").alias("submission_id"), F.col("quality").cast("string").alias("label"),
                          F.when(F.col("doc_id") % 2 == 0, "expert").alias("labeler"), F.when(F.col("doc_id") % 3 == 0, 4.5).alias("confidence"))
    return L.normalise_labels(raw, labeler="file_import")


@query("s21_label_files", """select cast(doc_id as varchar) as submission_id, quality as label, case when doc_id % 2 = 0 then 'expert' else 'file_import' end as labeler,
 case when doc_id % 3 = 0 then 4.5 else 5.0 end::double as confidence, case when doc_id % 5 = 0 then 'see, "' || doc_id || '"' else '' end as notes from labels""")
def _(t):
    """Label files as they come: half as CSV with quoted notes, half as JSON lines without the columns that are empty."""
    raw = t.labels.select(
        F.col("doc_id").cast("string").alias("submission_id"), F.col("quality").cast("string").alias("label"),
        F.when(F.col("doc_id") % 2 == 0, "expert").alias("labeler"), F.when(F.col("doc_id") % 3 == 0, 4.5).alias("confidence"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('see, "'), F.col("doc_id").cast("string"), F.lit('"'))).alias("notes"))
    half = F.col("submission_id").cast("bigint") % 4 < 2
    table, lines = scratch_path(t.spark, "labels-csv"), scratch_path(t.spark, "labels-json")
    raw.where(half).write.options(header=True, escape='"').csv(table)
    raw.where(~half).write.json(lines)
    read = [L.normalise_labels(L.read_labels(t.spark, path, kind), labeler="file_import") for path, kind in ((table, "csv"), (lines, "json"))]
    return read[0].unionByName(read[1])


@query("s21_label_words", "select doc_id as submission_id, quality as label, 'default' as labeler from labels")
def _(t):
    raw = t.labels.select(F.col("doc_id").alias("submission_id"), F.when(F.col("quality") == 1, "relevant").otherwise("other").alias("label"))
    return L.normalise_labels(raw, from_interface=True).select("submission_id", "label", "labeler")


_ATTACH = """select id as submission_id, label, case when id in (select doc_id from labels where doc_id % 2 = 0) then 'duplicate'
 when id not in (select doc_id from documents) then 'not_found' else 'added' end as reason from (select case when doc_id % 10 = 3 then doc_id + 100000000 else doc_id end as id, quality as label from labels)"""


def _attach(t):
    wanted = t.labels.select(F.when(F.col("doc_id") % 10 == 3, F.col("doc_id") + 100_000_000).otherwise(F.col("doc_id")).alias("submission_id"),
                             F.col("quality").alias("label"))
    existing = t.labels.where("doc_id % 2 = 0").select(F.col("doc_id").alias("submission_id"))
    return L.attach_labels(wanted, existing, t.documents.select(F.col("doc_id").alias("submission_id")))


@query("j04_label_attach", _ATTACH)
def _(t):
    return _attach(t)


@query("j04_attach_counts", f"""select count(*) as total_requested, count(case when reason = 'added' then 1 end) as successfully_added,
 count(case when reason = 'duplicate' then 1 end) as duplicates_skipped, count(case when reason = 'not_found' then 1 end) as failed_lookups,
 round(count(case when reason = 'added' then 1 end) / count(*), 6) as success_rate from ({_ATTACH})""")
def _(t):
    return L.attach_counts(_attach(t)).withColumn("success_rate", F.round("success_rate", 6))


@query("j05_existing_split", "select doc_id as submission_id, doc_id in (select doc_id from labels) as \"exists\" from documents")
def _(t):
    return RS.split_known(t.documents.select(F.col("doc_id").alias("submission_id")), t.labels.select(F.col("doc_id").alias("submission_id")))


@query("j06_label_update", with_views("""select submission_id, case when submission_id % 4 = 0 then 1 - label else label end as label,
 case when submission_id % 4 = 0 then 'updated' else labeler end as labeler from labelled where submission_id % 9 <> 0""", "labelled"))
def _(t):
    base = t.labelled.select("submission_id", "label", "labeler", F.lit(0).alias("ts"))
    changes = base.where("submission_id % 4 = 0").select("submission_id", (1 - F.col("label")).alias("label"), F.lit("updated").alias("labeler"), F.lit(1).alias("ts"))
    unknown = changes.withColumn("submission_id", -F.col("submission_id") - 1)
    updated = L.update_labels(base, changes.unionByName(unknown))
    return L.remove_labels(updated, base.where("submission_id % 9 = 0").select("submission_id")).drop("ts")


@query("a36_merged_sets", with_views("""select count(*) as n, sum(label)::bigint as positives, 'a,b,c' as sources from (select * from labelled union all select * from labelled where label = 1)""", "labelled"))
def _(t):
    a = t.labelled.withColumn("sources", F.array(F.lit("a"), F.lit("b")))
    b = t.labelled.where("label = 1").withColumn("sources", F.array(F.lit("b"), F.lit("c")))
    merged = L.merge_sets([a, b]).withColumn("source", F.explode("sources"))
    # a set of source names is tiny; rows are counted on the unexploded side
    names = merged.select(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return L.merge_sets([a, b]).agg(
        F.count("*").alias("n"), F.sum("label").alias("positives"),
        F.array_join(F.sort_array(F.flatten(F.collect_set("sources"))), ",").alias("all")).select(
        "n", "positives", F.array_join(F.array_distinct(F.split("all", ",")), ",").alias("sources"))


# ----------------------------------------------------------------- requests

def _docs(t):
    return S.content(t.documents_doc.withColumnRenamed("parts", "comments"), max_comments=None).withColumn("title", F.col("subreddit"))


_REQ = """select day, submission_id, i, day || '_' || submission_id || '_c' || i as custom_id,
 'Title: ' || subreddit || chr(10) || 'Body: ' || coalesce(nullif(parts[1], ''), 'No submission body') || chr(10) || 'Comments: ' || coalesce(nullif(c, ''), 'No comments') as prompt
 from (select day, submission_id, subreddit, parts, unnest(case when len(parts) > 1 then parts[2:] else [null] end) as c,
 unnest(case when len(parts) > 1 then range(0, len(parts[2:])) else [0] end) as i from documents_doc)"""


def requests_of(t):
    return R.build_requests(_docs(t), TEMPLATE, MODEL, system="Return structured sentiment info.")


@query("s23_extraction_requests", with_views("select custom_id, md5(prompt) as digest from req", "documents_doc", req=_REQ))
def _(t):
    return requests_of(t).select("custom_id", F.md5(F.get_json_object("line", "$.body.messages[1].content")).alias("digest"))


_S24_N, _S24_BYTES = 100, 200_000


_S24_SIZE = f"""octet_length(encode('{{"custom_id":' || to_json(custom_id) || ',"method":"POST","url":"/v1/chat/completions","body":{{"model":"{MODEL}","temperature":0,"messages":[{{"role":"system","content":"Return structured sentiment info."}},{{"role":"user","content":' || to_json(prompt) || '}}]}}}}'))"""


@query("s24_request_jobs", with_views(
    f"""select day, custom_id, size as bytes, day || '-' || job as job, size > {_S24_BYTES} as oversized from walk""", "documents_doc", req=_REQ,
    lined=f"""select *, row_number() over (partition by day order by submission_id, i) as p from (select day, cast(submission_id as varchar) as submission_id, i, custom_id, {_S24_SIZE} as size from req)""",
    walk=f"""select day, p, custom_id, size, 0 as job, size as held, 1 as k from lined where p = 1 union all
     select l.day, l.p, l.custom_id, l.size, case when w.k + 1 > {_S24_N} or w.held + l.size > {_S24_BYTES} then w.job + 1 else w.job end,
      case when w.k + 1 > {_S24_N} or w.held + l.size > {_S24_BYTES} then l.size else w.held + l.size end,
      case when w.k + 1 > {_S24_N} or w.held + l.size > {_S24_BYTES} then 1 else w.k + 1 end from walk w join lined l on l.day = w.day and l.p = w.p + 1"""))
def _(t):
    """Every request with its job, as one pass that fills jobs in order gives them."""
    packed = R.pack_requests(requests_of(t), max_requests=_S24_N, max_bytes=_S24_BYTES)
    return packed.select("day", "custom_id", "bytes", "job", "oversized")


@query("s25_extraction_outputs", with_views(
    """select strftime(date, '%Y%m%d') as date, cast(submission_id as varchar) as submission_id, count(*) as n, sum(confidence)::bigint as conf,
        min(ticker) as first_ticker from sentiments where pos % 7 <> 0 and pos % 5 <> 0 and pos % 11 <> 0 group by 1, 2""", "sentiments"))
def _(t):
    s = t.sentiments
    record = F.struct("confidence", F.concat(F.lit("$"), F.lower("ticker")).alias("ticker"), "is_implicit", "sentiment", "sentiment_intensity",
                      "position", "conviction", "time_horizon", "source", F.lit("x").alias("explanation"), "extraction_refusal")
    arguments = F.to_json(F.struct(F.col("ticker").alias("primary_ticker"), F.array(record).alias("sentiments"), F.array().cast("array<string>").alias("ticker_relationships")))
    arguments = F.when(F.col("pos") % 5 == 0, F.substring(arguments, 1, 30)).otherwise(arguments)  # cut JSON
    call = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.struct(arguments.alias("arguments")).alias("function"))).alias("tool_calls")).alias("message"))).alias("choices"))
    body = F.when(F.col("pos") % 11 == 0, '{"error":"overloaded"}').otherwise(F.to_json(call))
    date = F.date_format("date", "yyyyMMdd")
    name = F.concat(F.when(F.col("pos") % 7 == 0, "bad").otherwise(date), F.lit("_"), F.col("submission_id").cast("string"), F.lit("_c"), F.col("pos").cast("string"))
    lines = s.select(F.concat(F.lit('{"custom_id":"'), name, F.lit('","response":{"body":'), body, F.lit("}}")).alias("value"))
    opinions = R.flatten_opinions(R.parse_outputs(lines))
    return opinions.groupBy("date", "submission_id").agg(F.count("*").alias("n"), F.sum("confidence").alias("conf"), F.min("ticker").alias("first_ticker"))


_PAIR = "case when kind <> 'causal' and ticker > other then other else ticker end as ticker1, case when kind <> 'causal' and ticker > other then ticker else other end as ticker2"


@query("s25_relationships", with_views(
    f"""select date, ticker1, ticker2, kind as relationship_type, count(*) as mentions, count(distinct submission_id) as submissions, round(avg(confidence), 6) as avg_confidence
        from (select strftime(date, '%Y%m%d') as date, submission_id, confidence, kind, {_PAIR} from (select *, concat('T', lpad(cast(sentiment_intensity - 1 as varchar), 2, '0')) as other,
         case pos % 3 when 0 then 'inverse' when 1 then 'correlated' else 'causal' end as kind from sentiments)) group by 1, 2, 3, 4""", "sentiments"))
def _(t):
    s = t.sentiments
    kind = F.when(F.col("pos") % 3 == 0, "inverse").when(F.col("pos") % 3 == 1, "correlated").otherwise("causal")
    other = F.concat(F.lit("$t"), F.lpad((F.col("sentiment_intensity") - 1).cast("string"), 2, "0"))
    link = F.struct(F.col("ticker").alias("ticker1"), other.alias("ticker2"), kind.alias("relationship_type"), F.lit("x").alias("description"), "confidence")
    answers = s.select(
        F.concat(F.date_format("date", "yyyyMMdd"), F.lit("_"), F.col("submission_id").cast("string"), F.lit("_c"), F.col("pos").cast("string")).alias("custom_id"),
        F.to_json(F.struct(F.col("ticker").alias("primary_ticker"), F.array().cast("array<string>").alias("sentiments"), F.array(link).alias("ticker_relationships"))).alias("arguments"))
    out = R.relationship_counts(R.flatten_relationships(R.parse_arguments(answers)))
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6))


def _toy_extractor(text: str) -> str:
    if len(text) % 10 == 0:
        raise ValueError("refused")
    return '{"primary_ticker": null, "sentiments": []}'


@query("u04_extractor_hook", with_views(
    """select day as date, cast(submission_id as varchar) as submission_id, count(case when length(prompt) % 10 <> 0 then 1 end) as extraction_count,
        count(case when length(prompt) % 10 = 0 then 1 end) as failed_count from req group by 1, 2""", "documents_doc", req=_REQ))
def _(t):
    return R.extraction_counts(R.run_extractor(requests_of(t), R.guarded(_toy_extractor)))


@query("u06_token_counter_hook", with_views("select submission_id::varchar as submission_id, sum(len(string_split(prompt, ' ')))::bigint as tokens from req group by 1", "documents_doc", req=_REQ))
def _(t):
    @F.pandas_udf("int")
    def by_blanks(s):
        return s.str.count(" ") + 1

    out = K.submission_tokens(requests_of(t), 0, count=by_blanks)
    return out.select("submission_id", F.col("total_input_tokens").alias("tokens"))


_TOK = f"""select day, submission_id::varchar as submission_id, count(*) as num_extractions, sum({SYSTEM_TOKENS} + ceil(length(prompt) / 4))::bigint as total_input_tokens,
 avg({SYSTEM_TOKENS} + ceil(length(prompt) / 4)) as avg_tokens, max({SYSTEM_TOKENS} + ceil(length(prompt) / 4))::bigint as max_tokens from req group by 1, 2"""
_COST = "(sum_in / 1000000 * 0.4 + n * 300 / 1000000 * 1.6)"


def _tokens(t):
    return K.submission_tokens(requests_of(t), SYSTEM_TOKENS)


@query("a26_token_costs", with_views(
    f"""select submission_id, num_extractions, total_input_tokens, round(avg_tokens, 6) as avg_tokens, max_tokens,
        round({_COST.replace('sum_in', 'total_input_tokens').replace('n * 300', 'num_extractions * 300')}, 8) as total_cost from tok""", "documents_doc", req=_REQ, tok=_TOK))
def _(t):
    out = K.with_cost(_tokens(t), MODEL)
    return out.select("submission_id", "num_extractions", "total_input_tokens", F.round("avg_tokens", 6).alias("avg_tokens"), "max_tokens", F.round("total_cost", 8).alias("total_cost"))


_DAYS = f"select day, count(*) as num_submissions, sum(num_extractions)::bigint as n, sum(total_input_tokens)::bigint as sum_in from tok group by day"


@query("a26_day_costs", with_views(
    f"select day, num_submissions, n as num_extractions, sum_in as total_input_tokens, round({_COST}, 8) as total_cost, round(n / 8, 6) as estimated_minutes from days",
    "documents_doc", req=_REQ, tok=_TOK, days=_DAYS))
def _(t):
    out = K.day_costs(_tokens(t), MODEL)
    return out.select("day", "num_submissions", "num_extractions", "total_input_tokens", F.round("total_cost", 8).alias("total_cost"), F.round("estimated_minutes", 6).alias("estimated_minutes"))


@query("a27_range_cost", with_views(
    f"""select n_days as total_dates, count(*) as dates_sampled, count(*) < n_days as is_sampled, round_even(sum(num_submissions) * n_days / count(*), 0)::bigint as estimated_submissions,
        round_even(sum(n) * n_days / count(*), 0)::bigint as estimated_extractions, round(sum({_COST}) * n_days / count(*), 6) as estimated_cost
        from (select *, row_number() over (order by day) - 1 as i, count(*) over () as n_days from days) group by n_days""",
    "documents_doc", req=_REQ, tok=_TOK, days=_DAYS))
def _(t):
    out = K.range_cost(K.day_costs(_tokens(t), MODEL))
    return out.select("total_dates", "dates_sampled", "is_sampled", "estimated_submissions", "estimated_extractions", F.round("estimated_cost", 6).alias("estimated_cost"))


@query("a28_past_costs", with_views(
    """select date, e as total_extractions, round(e * 1000 / 1000000 * 0.4 + e * 300 / 1000000 * 1.6, 8) as total_cost,
        round((e * 1000 / 1000000 * 0.4 + e * 300 / 1000000 * 1.6) / n, 8) as cost_per_submission
        from (select date, count(*) as n, sum(extraction_count)::bigint as e from r group by date)""", r=RESULTS))
def _(t):
    out = K.past_costs(RS.result_totals(results(t)), MODEL)
    return out.select("date", "total_extractions", F.round("total_cost", 8).alias("total_cost"), F.round("cost_per_submission", 8).alias("cost_per_submission"))


_RATE = "case when model like '%gpt-4o-mini%' then {0} when model like '%gpt-4.1-mini%' then {1} when model like '%gpt-4.1%' then {2} else 1.0 end"


@query("a37_run_metrics", with_views(
    f"""select model, n as total_extractions, e as total_errors, round(n / (n + e), 6) as success_rate, ti + tk as total_tokens, round((ti + tk) / n, 6) as avg_tokens,
        round(n * 1000000 / (epoch_us(hi) - epoch_us(lo)), 8) as extractions_per_second, round(ti / 1000000 * {_RATE.format(0.15, 0.4, 2.0)} + tk / 1000000 * {_RATE.format(0.6, 1.6, 8.0)}, 8) as total_cost
        from (select model, count(case when not failed then 1 end) as n, count(case when failed then 1 end) as e, sum(case when not failed then input_tokens else 0 end)::bigint as ti,
        sum(case when not failed then output_tokens else 0 end)::bigint as tk, min(ts) as lo, max(ts) as hi from request_log group by model)""", "request_log"))
def _(t):
    out = K.run_metrics(t.request_log)
    return out.select("model", "total_extractions", "total_errors", F.round("success_rate", 6).alias("success_rate"), "total_tokens", F.round("avg_tokens", 6).alias("avg_tokens"),
                      F.round("extractions_per_second", 8).alias("extractions_per_second"), F.round("total_cost", 8).alias("total_cost"))


@query("w11_trailing_usage", with_views(
    """select event_id, count(*) over f as current_rpm, (sum(input_tokens + output_tokens) over f)::bigint as current_tpm, round((count(*) over f) / 450.0, 6) as rpm_utilization
       from request_log window f as (partition by user_id % 3 order by ts range between interval 600 seconds preceding and current row)""", "request_log"))
def _(t):
    log = t.request_log.withColumn("key", F.col("user_id") % 3)
    out = K.trailing_usage(log, "key", seconds=600)
    return out.select("event_id", "current_rpm", "current_tpm", F.round("rpm_utilization", 6).alias("rpm_utilization"))


# -------------------------------------------------------------- predictions

_REL = "predicted_label = 1 and confidence >= 0.7 and error is null"


@query("f05_relevant_submissions", with_views(f"select submission_id, confidence from predictions where {_REL}", "predictions"))
def _(t):
    return P.relevant(t.predictions).select("submission_id", "confidence")


@query("f05_threshold", with_views("select submission_id from predictions where error is null and probability_relevant >= 0.5", "predictions"))
def _(t):
    return P.above_threshold(t.predictions).select("submission_id")


@query("m17_export_relevant", with_views("select submission_id, date_folder, confidence, date_folder || '/' || submission_id || '.json' as file_path from predictions where predicted_label = 1 and confidence >= 0.8 and error is null", "predictions"))
def _(t):
    return P.export_relevant(t.predictions)


@query("a22_prediction_summary", with_views(
    """select count(*) as total_predictions, count(error) as failed, sum(predicted_label)::bigint as relevant_count, round(avg(predicted_label), 6) as relevance_rate,
        round(avg(confidence), 6) as avg_confidence, min(confidence) as min_confidence, max(confidence) as max_confidence, min(date_folder) as first_date, max(date_folder) as last_date from predictions""", "predictions"))
def _(t):
    out = P.prediction_summary(t.predictions)
    return out.select("total_predictions", "failed", "relevant_count", F.round("relevance_rate", 6).alias("relevance_rate"), F.round("avg_confidence", 6).alias("avg_confidence"),
                      "min_confidence", "max_confidence", "first_date", "last_date")


@query("a23_daily_predictions", with_views(
    """select date_folder, count(submission_id) as total_submissions, sum(predicted_label)::bigint as relevant_count, round(avg(predicted_label), 3) as relevance_rate,
        round(avg(confidence), 3) as avg_confidence, count(error) as error_count from predictions group by date_folder""", "predictions"))
def _(t):
    return P.daily_prediction_stats(t.predictions)


@query("a24_scoring_summary", with_views(
    """select count(*) as total, count(case when error is null then 1 end) as successful, count(error) as failed, count(case when error is null and predicted_label = 1 then 1 end) as relevant,
        count(case when error is null and predicted_label = 0 then 1 end) as irrelevant, round(avg(case when error is null then confidence end), 6) as avg_confidence from predictions""", "predictions"))
def _(t):
    return P.scoring_summary(t.predictions).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("s09_prediction_sink", with_views("select f, count(*) as n, sum(predicted_label)::bigint as relevant, round(sum(confidence), 4) as conf from predictions, (select unnest(['parquet', 'csv', 'json']) as f) group by f", "predictions"))
def _(t):
    schema = t.predictions.schema
    parts = []
    for fmt in ("parquet", "csv", "json"):
        path = scratch_path(t.spark, "predictions")
        writer = t.predictions.write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
        reader = t.spark.read.schema(schema)
        back = (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)
        parts.append(back.agg(F.count("*").alias("n"), F.sum("predicted_label").cast("bigint").alias("relevant"), F.round(F.sum("confidence"), 4).alias("conf")).withColumn("f", F.lit(fmt)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

"""Input views derived from the driver tables.

One SQL text per view serves Spark and the SQL oracle, so both sides see the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "sentiments": """
select cast(o.o_orderdate as date) as date, l.l_orderkey as submission_id,
 cast(row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) as bigint) as pos,
 concat('T', lpad(cast(l.l_partkey % 10 as varchar(10)), 2, '0')) as ticker,
 cast(1 + (cast(l.l_quantity as bigint) - 1) % 10 as int) as confidence,
 cast(1 + (l.l_partkey + l.l_linenumber) % 10 as int) as sentiment_intensity,
 (l.l_suppkey % 4 = 0) as is_implicit,
 case when l.l_returnflag = 'N' then 'bullish' when l.l_returnflag = 'R' then 'bearish' when l.l_suppkey % 2 = 0 then 'neutral' else 'unclear' end as sentiment,
 case l.l_suppkey % 5 when 0 then 'shares' when 1 then 'calls' when 2 then 'puts' when 3 then 'spreads' else 'watching' end as position,
 case l.l_partkey % 6 when 0 then 'yolo' when 1 then 'high' when 2 then 'moderate' when 3 then 'low' when 4 then 'hedge' else 'unclear' end as conviction,
 case l.l_linenumber % 4 when 0 then 'day' when 1 then 'swing' when 2 then 'long' else 'unclear' end as time_horizon,
 case l.l_suppkey % 3 when 0 then 'submission' when 1 then 'comments' else 'both' end as source,
 (l.l_partkey % 17 = 0) as extraction_refusal
from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey""",
    "prices": """
select concat('T', lpad(cast(o_custkey % 10 as varchar(10)), 2, '0')) as ticker, cast(o_orderdate as date) as date,
 avg(o_totalprice) as close, min(o_totalprice) as low, max(o_totalprice) as high,
 min_by(o_totalprice, o_orderkey) as open, cast(count(*) * 100 as bigint) as volume
from {orders} group by 1, 2""",
    "replies": """
select conv_id as submission_id, concat('c', cast(turn as varchar(10))) as id, turn as pos,
 case when turn = 1 then concat('t3_', cast(conv_id as varchar(20))) else concat('t1_c', cast(cast(floor(turn / 2) as int) as varchar(10))) end as parent_id,
 text as body, cast(conv_id * 7 + turn * 3 as int) % 21 - 5 as score
from {conversations} where turn > 0""",
    # the dump as CSV rows: submissions from documents, comments from conversations
    "csv_submissions": """
select concat('u/', source) as author, substr(text, 1, 40) as title, cast(doc_id % 50 as bigint) as score,
 case when doc_id % 41 = 0 then 'bad date' when doc_id % 43 = 0 then null
  else concat(cast(2018 + doc_id % 6 as varchar(4)), '-0', cast(1 + doc_id % 9 as varchar(1)), '-1', cast(doc_id % 10 as varchar(1)), ' 08:3', cast(doc_id % 10 as varchar(1))) end as created,
 concat('https://www.reddit.com/r/', source, '/comments/', cast(doc_id as varchar(20)), '/title/') as link,
 case when doc_id % 29 = 0 then '[removed]' when doc_id % 31 = 0 then null else text end as text,
 concat('https://example.org/', cast(doc_id as varchar(20))) as url, source as subreddit
from {documents}""",
    "csv_comments": """
select concat('u/', role) as author, cast(conv_id * 7 + turn * 3 as bigint) % 21 - 5 as score,
 case when conv_id % 13 = 0 then '2017-05-01 10:00' else concat('2021-0', cast(1 + turn % 9 as varchar(1)), '-11 09:00') end as created,
 concat('https://www.reddit.com/r/x/comments/', cast(conv_id as varchar(20)), '/title/c', cast(turn as varchar(10)), '/') as link,
 case when (conv_id + turn) % 17 = 0 then '[deleted]' when (conv_id + turn) % 19 = 0 then null else text end as body,
 conv_id * 1000 + turn as file_pos
from {conversations}""",
    # consensus-like daily scores straight from the opinions
    "opinion_days": """
select ticker, date, sum(case when side = 'N' then c * i * w else 0.0 end) as bull_score, sum(case when side = 'R' then c * i * w else 0.0 end) as bear_score,
 cast(sum(case when side = 'N' then 1 else 0 end) as bigint) as n_bull, cast(sum(case when side = 'R' then 1 else 0 end) as bigint) as n_bear
from (select concat('T', lpad(cast(l.l_partkey % 10 as varchar(10)), 2, '0')) as ticker, cast(o.o_orderdate as date) as date, l.l_returnflag as side,
  cast(1 + (cast(l.l_quantity as bigint) - 1) % 10 as double) as c, cast(1 + (l.l_partkey + l.l_linenumber) % 10 as double) as i,
  cast(1 + l.l_partkey % 3 as double) as w from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey) x
group by ticker, date""",
    # raw dump lines: some without a permalink or own text
    "dump_lines": """
select source as author, substr(text, 1, 30) as title, cast(doc_id % 50 as bigint) as score, cast(1500000000 + doc_id * 86411 as bigint) as created_utc,
 case when doc_id % 3 = 0 then null else concat('/r/', source, '/comments/', cast(doc_id as varchar(20)), '/t/') end as permalink,
 concat('t3_', cast(doc_id + 7 as varchar(20))) as link_id, concat('c', cast(doc_id as varchar(20))) as id, source as subreddit,
 case when doc_id % 4 = 0 then null else text end as selftext, concat('https://example.org/', cast(doc_id as varchar(20))) as url, text as body
from {documents}""",
    # line 1 is the body, the other lines are comments
    "documents_doc": """
select d.doc_id as submission_id, d.source as subreddit, d.lang, split(d.text, chr(10)) as parts, l.quality as label,
 concat('202401', lpad(cast(1 + d.doc_id % 28 as varchar(2)), 2, '0')) as day
from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    # one row per submission and day with its processing state and session
    "processing_log": """
select cast(cast(o_orderdate as date) as varchar(10)) as date, o_orderkey as submission_id,
 case o_orderstatus when 'F' then 'processed' when 'P' then 'failed' else 'skipped' end as status,
 concat('s', cast(o_custkey % 5 as varchar(5))) as session_id, o_orderkey as ts
from {orders} where o_orderkey % 3 <> 0""",
    # one request-log row per event
    "request_log": """
select user_id, event_id, ts, event_type = 'error' as failed,
 cast(100 + floor(value * 10) as bigint) as input_tokens, cast(20 + event_id % 50 as bigint) as output_tokens,
 case event_id % 4 when 0 then 'gpt-4.1' when 1 then 'gpt-4.1-mini' when 2 then 'gpt-4o-mini-2024' else 'other' end as model
from {events}""",
    "labelled": """
select d.doc_id as submission_id, l.quality as label,
 case d.doc_id % 3 when 0 then 'manual' when 1 then 'expert' else 'batch' end as labeler,
 cast(1 + d.doc_id % 5 as double) as confidence
from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    # predictions: score from text size, error rows for some documents
    "predictions": """
select doc_id as submission_id, concat('2024-01-', lpad(cast(1 + doc_id % 28 as varchar(2)), 2, '0')) as date_folder,
 case when doc_id % 37 = 0 then 0 when n_chars % 100 >= 40 then 1 else 0 end as predicted_label,
 case when doc_id % 37 = 0 then 0.0 else cast(n_chars % 100 as double) / 100 end as probability_relevant,
 case when doc_id % 37 = 0 then 0.0 when n_chars % 100 >= 50 then cast(n_chars % 100 as double) / 100
  else 1 - cast(n_chars % 100 as double) / 100 end as confidence,
 case when doc_id % 37 = 0 then 'unreadable' end as error
from {documents}""",
}
# tables that a view joins on one key and then orders by it: dealt by that key into as many parts as the first one has ROWS_A_PART
DEALT = {"sentiments": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}
ROWS_A_PART = 100_000
_NEEDS = {name: sorted(set(re.findall(r"\{(\w+)\}", text))) for name, text in VIEWS.items()}


class Tables:
    """Lazy access to the driver tables and the derived views of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def view(self, name: str) -> DataFrame:
        inputs = {need: self.table(need) for need in _NEEDS[name]}
        if name in DEALT:
            parts = self.parts_for(inputs[next(iter(DEALT[name]))])
            inputs |= {need: inputs[need].repartition(parts, key) for need, key in DEALT[name].items()}
        return self.spark.sql(VIEWS[name], **inputs)

    def parts_for(self, rows: DataFrame) -> int:
        """Parts of at most some ``ROWS_A_PART`` rows, so a task's share stays the same however many rows come.

        Adaptive execution would join parts until a task holds 64 MB as shuffled, which is a gigabyte when grouped.
        Counting the rows reads the footers of the files only.
        """
        return max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_PART))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.view(name) if name in VIEWS else self.table(name)


def with_views(body: str, *names: str, **extra: str) -> str:
    """Oracle text: the named views, then the extra CTEs in order, then the body."""
    parts = [f"{n} as ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names]
    parts += [f"{n} as ({text})" for n, text in extra.items()]
    recursive = "recursive " if any("union all" in text and f"from {n} " in text for n, text in extra.items()) else ""
    return f"with {recursive}{', '.join(parts)} {body}" if parts else body

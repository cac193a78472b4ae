"""Dump rows and text to submission documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import ids as I, text as T
from tidemark.operators import dump as D, threads as H
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.plans.views import with_views
from tidemark.sources import documents as S, dump as U

TEMPLATE = "Title: {title}\nBody: {body}\nComments: {comment}"


def sig(c):
    """Length and digest of a text, which keeps results small and exact."""
    return [F.length(c).cast("bigint").alias("size"), F.md5(c.cast("binary")).alias("digest")]


def _sig(sql):
    return f"length({sql}) as size, md5({sql}) as digest"


# ------------------------------------------------------------- text columns

_ENT = "replace(replace(replace(replace(replace({x}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x200B;', '')"
_DUMP_CLEAN = "case when coalesce({x}, '') in ('nan', '[removed]', '[deleted]') then '' else trim(regexp_replace(" + \
    _ENT.replace("{x}", "coalesce({x}, '')") + r", '\s+', ' ', 'g')) end"


@query("c01_dump_text", f"select page_id, {_sig(_DUMP_CLEAN.replace('{x}', 'html'))} from pages")
def _(t):
    return t.pages.select("page_id", *sig(T.clean_dump_text("html")))


_NAMED = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"
_URLS = r"regexp_replace({x}, 'https?://\S+|www\.\S+', '', 'g')"
_MARKUP = r"regexp_replace(regexp_replace({x}, '!\[img\]\(emote\|[^)]+\)', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"
_USERS = r"regexp_replace({x}, '/u/\w+|u/\w+', '', 'g')"
_SUBS = r"regexp_replace({x}, '/r/\w+|r/\w+', '', 'g')"
_MARKERS = r"regexp_replace({x}, '\[deleted\]|\[removed\]', '', 'gi')"
_SPACE = r"regexp_replace({x}, '\s+', ' ', 'g')"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _nest(*steps, x):
    for step in steps:
        x = step.replace("{x}", x)
    return x


@query("c02_comment_clean", f"select page_id, {_sig(_nest(_NAMED, _URLS, _MARKUP, _MARKERS, _SPACE, _STRIP, x='html'))} from pages")
def _(t):
    return t.pages.select("page_id", *sig(T.clean_comment("html", entities="named")))


_CUT_200 = "case when length(c) > 200 then substr(c, 1, 197) || '...' else c end"


@query("c02_comment_clean_strict", with_views(
    f"select page_id, {_sig(_STRIP.replace('{x}', _CUT_200))} from cut",
    cut=f"select page_id, {_nest(_NAMED, _URLS, _MARKUP, _USERS, _SUBS, _MARKERS, _SPACE, x='html')} as c from pages"))
def _(t):
    c = T.clean_comment("html", entities="named", user_mentions=True, subreddit_mentions=True, max_length=200)
    return t.pages.select("page_id", *sig(c))


@query("c03_named_entities", f"select page_id, {_sig(_NAMED.replace('{x}', 'html'))} from pages")
def _(t):
    return t.pages.select("page_id", *sig(T.decode_named_entities("html")))


_RARE = "caf&eacute; &notit; &notin; &#8364;&#x1F600 &amp;lt; &#128; &#0; &CounterClockwiseContourIntegral; &fjlig;&unknown; &#xZ; "


def _decoded_views(source: str) -> dict[str, str]:
    """Pieces between ampersands, each with the longest name it begins with, put together again as ``text``."""
    quoted = {n: v.replace("'", "''") for rows in T.entity_names().values() for n, v in rows}
    listed = [", ".join(f"'{x}'" for x in side) for side in (quoted.keys(), quoted.values())]
    windows = ", ".join("'" + (bytes([n]).decode("cp1252", "ignore") or chr(n)) + "'" for n in range(128, 160))
    rule = "'^#([0-9]+|[xX][0-9a-fA-F]+);?'"
    return dict(
        ent=f"select unnest([{listed[0]}]) as n, unnest([{listed[1]}]) as v",
        piece=f"select page_id, unnest(string_split({source}, '&')) as p, generate_subscripts(string_split({source}, '&'), 1) as i from pages",
        named="select page_id, i, arg_max(n, length(n)) as n, arg_max(v, length(n)) as v from piece join ent on left(p, 2) = left(n, 2) and starts_with(p, n) where i > 1 group by 1, 2",
        coded=f"""select *, regexp_extract(p, {rule}, 0) as whole, coalesce(try_cast(case when lower(left(num, 1)) = 'x' then '0x' || substr(num, 2) else num end as bigint), 1099511627776) as cp
         from (select *, regexp_extract(p, {rule}, 1) as num from piece)""",
        told=f"""select c.page_id, c.i, case when c.i = 1 then p when num <> '' then case when cp = 0 or cp between 55296 and 57343 or cp > 1114111 then chr(65533)
          when cp between 128 and 159 then ([{windows}])[cp - 127] when cp between 1 and 8 or cp = 11 or cp between 14 and 31 or cp = 127 or cp between 64976 and 65007 or cp & 65534 = 65534 then ''
          else chr(cp::int) end || substr(p, length(whole) + 1) when n is not null then v || substr(p, length(n) + 1) else '&' || p end as t
         from coded c left join named d on c.page_id = d.page_id and c.i = d.i""",
        decoded="select page_id, string_agg(t, '' order by i) as text from told group by page_id")


@query("c03_all_entities", with_views(f"select page_id, {_sig('text')} from decoded", **_decoded_views(f"('{_RARE}' || html)")))
def _(t):
    return t.pages.select("page_id", *sig(T.decode_all_entities(F.concat(F.lit(_RARE), "html"))))


@query("c02_comment_clean_default", with_views(
    f"select page_id, {_sig(_nest(_URLS, _MARKUP, _MARKERS, _SPACE, _STRIP, x='text'))} from decoded", **_decoded_views(f"('{_RARE}' || html)")))
def _(t):
    return t.pages.select("page_id", *sig(T.clean_comment(F.concat(F.lit(_RARE), "html"))))


@query("c04_urls_and_markup", f"select page_id, {_sig(_nest(_URLS, _MARKUP, x=chr(39) + '[see](' + chr(39) + ' || url || ' + chr(39) + ') ' + chr(39) + ' || html'))} from pages")
def _(t):
    text = F.concat(F.lit("[see]("), "url", F.lit(") "), "html")
    return t.pages.select("page_id", *sig(T.remove_markup(T.remove_urls(text))))


@query("c05_mentions_and_markers", f"select page_id, {_sig(_nest(_USERS, _SUBS, _MARKERS, x=chr(39) + '/u/ab r/cd [DELETED] ' + chr(39) + ' || html'))} from pages")
def _(t):
    text = F.concat(F.lit("/u/ab r/cd [DELETED] "), "html")
    return t.pages.select("page_id", *sig(T.remove_deleted_markers(T.remove_subreddit_mentions(T.remove_user_mentions(text)))))


@query("c06_whitespace_and_cut", with_views(
    f"select doc_id, {_sig('case when length(c) > 120 then substr(c, 1, 117) || ' + chr(39) + '...' + chr(39) + ' else c end')} from n",
    n=f"select doc_id, {_SPACE.replace('{x}', 'text')} as c from documents"))
def _(t):
    return t.documents.select("doc_id", *sig(T.truncate(T.collapse_whitespace("text"), 120)))


_WORDS = r"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


@query("c07_text_metrics", rf"""
select doc_id, length(text)::int as length, {_WORDS.replace('{x}', 'text')}::int as word_count,
 len(list_filter(string_split(text, '.'), lambda s: regexp_matches(s, '\S')))::int as sentence_count,
 regexp_matches(text, 'https?://\S+|www\.\S+') as contains_urls, regexp_matches(text, '/u/\w+|u/\w+') as contains_user_mentions,
 regexp_matches(text, '/r/\w+|r/\w+') as contains_subreddit_mentions, len(string_split(text, chr(10)))::int as line_count,
 round(len(regexp_extract_all(text, '\p{{Lu}}')) / length(text), 6) as uppercase_ratio,
 len(regexp_extract_all(text, '[!?.,;:]'))::int as punctuation_count from documents where text <> ''""")
def _(t):
    m = T.text_metrics("text")
    m["uppercase_ratio"] = F.round(m["uppercase_ratio"], 6)
    return t.documents.where("text <> ''").select("doc_id", *[c.alias(n) for n, c in m.items()])


@query("c08_low_quality", rf"""
select doc_id, count(*) as lines, sum(low::int)::bigint as low_lines from (select doc_id,
 s = '' or regexp_matches(s, '(?i)^(lol|lmao|wtf|omg|this|nice|cool|wow|ok|okay)\.?$') or regexp_matches(s, '^[\w\p{{L}}]{{1,2}}$')
 or regexp_matches(s, '^[^\p{{L}}\p{{N}}\p{{M}}]+$') or {_WORDS.replace('{x}', 's')} < 3 as low
 from (select doc_id, {_STRIP.replace('{x}', 'unnest(string_split(text, chr(10)))')} as s from documents)) group by doc_id""")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    low = T.is_low_quality("line")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(F.when(low, 1)).alias("low_lines"))


@query("c09_normalised_tickers", with_views(
    """select submission_id, pos, trim(upper(replace(raw, '$', ''))) as ticker, trim(upper(raw)) as plain_ticker
       from (select submission_id, pos, ' $' || lower(ticker) || ' ' as raw from sentiments)""", "sentiments"))
def _(t):
    raw = F.concat(F.lit(" $"), F.lower("ticker"), F.lit(" "))
    return t.sentiments.select("submission_id", "pos", T.normalise_ticker(raw).alias("ticker"),
                               T.normalise_ticker(raw, strip_dollar=False).alias("plain_ticker"))


@query("c10_submission_id_from_link", with_views(
    "select link, nullif(regexp_extract(regexp_replace(link, '[?#].*$', ''), '/comments/([^/]*)', 1), '') as submission_id from links", "csv_submissions",
    links="select link from csv_submissions union all select url || '/comments/' || page_id || '/x?y=/comments/1/' as link from pages"))
def _(t):
    extra = t.pages.select(F.concat("url", F.lit("/comments/"), F.col("page_id").cast("string"), F.lit("/x?y=/comments/1/")).alias("link"))
    links = t.csv_submissions.select("link").unionByName(extra)
    return links.select("link", I.submission_id_from_link("link").alias("submission_id"))


@query("c11_scored_lines", with_views(
    """select submission_id, id, 'Top level comment: ' || body || ' (score ' || coalesce(case when score % 5 = 0 then null else score end, 0) || ')' as line
       from replies""", "replies"))
def _(t):
    score = F.when(F.col("score") % 5 != 0, F.col("score"))
    return t.replies.select("submission_id", "id", T.scored_line(F.col("body"), score, "Top level comment").alias("line"))


_TREE = """select submission_id, id, pos, id as root, cast([] as bigint[]) as path, 1 as depth, body, score from replies where parent_id like 't3\\_%' escape '\\'
 union all select r.submission_id, r.id, r.pos, t.root, list_append(t.path, r.pos), t.depth + 1, r.body, r.score
 from tree t join replies r on r.submission_id = t.submission_id and r.parent_id = 't1_' || t.id"""
_BODY = r"regexp_replace(coalesce(body, ''), '^\s+|\s+$', '', 'g')"
_THREADS = f"""select submission_id, root, pos, 'Top level comment: ' || head || case when n > 0 then '; Replies: ' || tail else '' end as thread from (
 select submission_id, root, max(case when id = root then {_BODY} || ' (score ' || score || ')' end) as head, max(case when id = root then pos end) as pos,
 count(case when id <> root and {_BODY} <> '' then 1 end) as n,
 string_agg(case when id <> root and {_BODY} <> '' then {_BODY} || ' (score ' || score || ')' end, '; ' order by path) as tail
 from tree group by submission_id, root) where head is not null"""


@query("c12_thread_lines", with_views("select submission_id, root, pos, thread from threads", "replies", tree=_TREE, threads=_THREADS))
def _(t):
    return H.thread_texts(H.locate_comments(t.replies)).select("submission_id", "root", "pos", "thread")


@query("c13_thread_documents", with_views(
    f"""select c.conv_id as submission_id, {_sig("'Submission body: ' || " + _STRIP.replace('{x}', 'c.text') + " || coalesce(chr(10) || d.lines, '')")},
        1 + coalesce(d.n, 0) as n_entries from conversations c left join (select submission_id, count(*) as n,
        string_agg(thread, chr(10) order by pos) as lines from threads group by 1) d on d.submission_id = c.conv_id where c.turn = 0""",
    "replies", tree=_TREE, threads=_THREADS))
def _(t):
    heads = t.conversations.where("turn = 0").select(F.col("conv_id").alias("submission_id"), F.col("text").alias("selftext"))
    docs = H.thread_documents(heads, H.thread_texts(H.locate_comments(t.replies)))
    return docs.select("submission_id", *sig(F.array_join("comments", "\n")), F.size("comments").cast("bigint").alias("n_entries"))


@query("j10_thread_assembly", with_views(
    "select submission_id, id, root, row_number() over (partition by submission_id, root order by path) - 1 as rank from tree", "replies", tree=_TREE))
def _(t):
    located = H.locate_comments(t.replies).where("root is not null")
    return located.select("submission_id", "id", "root", "rank")


@query("j11_comment_depth", with_views("select submission_id, id, depth from tree", "replies", tree=_TREE))
def _(t):
    return H.locate_comments(t.replies).select("submission_id", "id", "depth")


@query("a19_comment_statistics", with_views(
    f"""select submission_id, count(*) as total, count(case when id = root then 1 end) as top_level,
        count(case when id <> root then 1 end) as replies, count(case when {_BODY} = '' then 1 end) as empty,
        max(score) as max_score, min(score) as min_score, round(avg(score), 6) as avg_score, sum(score)::bigint as total_score,
        round((count(*) - count(case when {_BODY} = '' then 1 end)) / count(*) * 100, 6) as success_rate,
        count(distinct root) as threads, count(distinct case when told_top > 0 and told_replies > 0 then root end) as threads_with_replies
        from (select *, count(case when id = root and {_BODY} <> '' then 1 end) over (partition by submission_id, root) as told_top,
         count(case when id <> root and {_BODY} <> '' then 1 end) over (partition by submission_id, root) as told_replies from tree) group by submission_id""", "replies", tree=_TREE))
def _(t):
    stats = H.comment_statistics(H.locate_comments(t.replies))
    return stats.select("submission_id", "total", "top_level", "replies", "empty", "max_score", "min_score", "total_score", "threads", "threads_with_replies",
                        F.round("avg_score", 6).alias("avg_score"), F.round("success_rate", 6).alias("success_rate"))


# ------------------------------------------------------- filters and documents

_TS = "try_strptime(created, '%Y-%m-%d %H:%M')"
_YEAR_OK = f"created is not null and ({_TS} is null or year({_TS}) >= 2020)"
_KEPT_SUBS = f"""select *, regexp_extract(link, '/comments/([^/?#]*)', 1) as sid from csv_submissions where {_YEAR_OK}
 and coalesce(title, '') not in ('[removed]', '[deleted]') and coalesce(text, '') not in ('[removed]', '[deleted]')"""
_KEPT_COMS = f"""select *, regexp_extract(link, '/comments/([^/?#]*)', 1) as sid from csv_comments where {_YEAR_OK}
 and coalesce(body, '') not in ('[removed]', '[deleted]')"""


def clean_rows(t):
    subs = D.drop_removed(D.filter_years(t.csv_submissions), "title", "text")
    coms = D.drop_removed(D.filter_years(t.csv_comments), "body")
    return subs, D.drop_orphans(coms, subs)


@query("f01_year_filter", with_views(f"select link from csv_submissions where {_YEAR_OK}", "csv_submissions"))
def _(t):
    return D.filter_years(t.csv_submissions).select("link")


@query("f02_drop_removed", with_views(
    "select link, length(coalesce(text, '')) as size from csv_submissions where coalesce(title, '') not in ('[removed]', '[deleted]') and coalesce(text, '') not in ('[removed]', '[deleted]')",
    "csv_submissions"))
def _(t):
    return D.drop_removed(t.csv_submissions, "title", "text").select("link", F.length("text").cast("bigint").alias("size"))


@query("j02_orphan_comments", with_views("select link from coms where sid in (select sid from subs)", "csv_submissions", "csv_comments",
                                         subs=_KEPT_SUBS, coms=_KEPT_COMS))
def _(t):
    return clean_rows(t)[1].select("link")


_CAP = 3
_CAPPED = f"""select *, case when cnt > {_CAP} then by_score else by_file end as place from (select *, count(*) over (partition by sid) as cnt,
 row_number() over (partition by sid order by score desc, file_pos) as by_score, row_number() over (partition by sid order by file_pos) as by_file
 from coms where sid in (select sid from subs)) where by_score <= {_CAP}"""


@query("j01_submission_comments", with_views(
    """select s.sid as submission_id, count(c.sid) as n_comments, coalesce(string_agg(c.link, ' ' order by c.file_pos), '') as links
       from subs s left join coms c on c.sid = s.sid group by s.sid""", "csv_submissions", "csv_comments", subs=_KEPT_SUBS, coms=_KEPT_COMS))
def _(t):
    subs, coms = clean_rows(t)
    lists = D.group_comments(D.cap_comments(coms))
    joined = D.with_submission_id(subs).select("submission_id").join(lists, "submission_id", "left")
    raw = F.coalesce(F.col("raw.link"), F.array().cast("array<string>"))
    return joined.select("submission_id", F.size(raw).cast("bigint").alias("n_comments"), F.array_join(raw, " ").alias("links"))


@query("t12_top_comments", with_views("select sid as submission_id, link, place from capped", "csv_submissions", "csv_comments",
                                      subs=_KEPT_SUBS, coms=_KEPT_COMS, capped=_CAPPED))
def _(t):
    return D.cap_comments(clean_rows(t)[1], _CAP).select("submission_id", "link", F.col("place").cast("bigint").alias("place"))


@query("c13_dump_documents", with_views(
    f"""select * from (select s.sid as submission_id, {_sig(_DUMP_CLEAN.replace('{x}', 's.title')).replace('size', 'title_size').replace('digest', 'title_digest')},
        coalesce(strftime({_TS.replace('created', 's.created')}, '%Y-%m-%dT%H:%M:%S'), s.created) as date, s.score as original_score,
        md5(concat_ws(chr(10), case when tx <> '' then 'Submission body: ' || tx || ' (score ' || s.score || ')' end, k.lines)) as comments_digest,
        coalesce(k.n, 0) as comment_count, coalesce(k.told, 0) + (tx <> '')::int as valid_comment_count,
        case when coalesce(k.n, 0) = 0 then 100.0 else round(k.told / k.n * 100, 2) end as success_rate
        from (select *, {_DUMP_CLEAN.replace('{x}', 'text')} as tx from subs) s left join (select sid, count(*) as n, count(case when b <> '' then 1 end) as told,
         string_agg(case when b <> '' then 'Top level comment: ' || b || ' (score ' || score || ')' end, chr(10) order by file_pos) as lines
         from (select *, {_DUMP_CLEAN.replace('{x}', 'body')} as b from coms where sid in (select sid from subs)) group by sid) k using (sid)) where valid_comment_count > 0""",
    "csv_submissions", "csv_comments", subs=_KEPT_SUBS, coms=_KEPT_COMS))
def _(t):
    subs, coms = clean_rows(t)
    docs = D.build_documents(subs, coms)
    return docs.select(
        "submission_id", F.length("title").cast("bigint").alias("title_size"), F.md5("title").alias("title_digest"), "date",
        "metadata.original_score", F.md5(F.array_join("comments", "\n")).alias("comments_digest"),
        "metadata.comment_count", "metadata.valid_comment_count",
        F.col("metadata.data_quality.processing_success_rate").alias("success_rate"))


@query("a20_conversion_report", with_views(
    """select 'submissions' as "table", count(*) as rows_in, count(case when not yr then 1 end) as filtered_by_year,
        count(case when yr and gone then 1 end) as removed, 0::bigint as orphan, count(case when yr and not gone then 1 end) as kept,
        count(case when yr and not gone and bad then 1 end) as date_parse_errors from s
       union all select 'comments', count(*), count(case when not yr then 1 end), count(case when yr and gone then 1 end),
        count(case when yr and not gone and not known then 1 end), count(case when yr and not gone and known then 1 end), 0 from c""",
    "csv_submissions", "csv_comments",
    s=f"""select coalesce({_YEAR_OK}, false) as yr, title in ('[removed]', '[deleted]') or coalesce(text, '') in ('[removed]', '[deleted]') as gone,
        {_TS} is null as bad from csv_submissions""", subs=_KEPT_SUBS,
    c=f"""select coalesce({_YEAR_OK}, false) as yr, coalesce(body, '') in ('[removed]', '[deleted]') as gone,
        regexp_extract(link, '/comments/([^/?#]*)', 1) in (select sid from subs) as known from csv_comments"""))
def _(t):
    return D.conversion_report(t.csv_submissions, t.csv_comments).drop("removal_rate", "orphan_rate", "year_filter_rate")


@query("t13_first_comments", with_views(
    "select submission_id, len(parts[2:4])::int as n, coalesce(array_to_string(parts[2:4], chr(10)), '') as comments from documents_doc", "documents_doc"))
def _(t):
    docs = S.content(t.documents_doc.withColumnRenamed("parts", "comments"), max_comments=3)
    return docs.select("submission_id", F.size("comments").alias("n"), F.array_join("comments", "\n").alias("comments"))


@query("s05_content_projection", with_views(
    f"select submission_id, parts[1] as submission_body, len(parts) - 1 as n_comments, md5(array_to_string(parts[2:], chr(10))) as digest from documents_doc",
    "documents_doc"))
def _(t):
    docs = S.content(t.documents_doc.withColumnRenamed("parts", "comments"))
    return docs.select("submission_id", "submission_body", F.size("comments").cast("bigint").alias("n_comments"),
                       F.md5(F.array_join("comments", "\n")).alias("digest"))


_WRITTEN: dict[tuple, str] = {}


def doc_store(t):
    """The documents written by day, once per session and folder, and read back."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _WRITTEN:
        path = scratch_path(t.spark, "doc-store")
        created = F.concat_ws("-", F.substring("day", 1, 4), F.substring("day", 5, 2), F.concat(F.substring("day", 7, 2), F.lit(" 08:00")))
        docs = t.documents_doc.select(F.col("submission_id").cast("string").alias("submission_id"), F.lit("t").alias("title"), created.alias("date"),
                                      "subreddit", F.col("parts").alias("comments"))
        S.write_documents(docs, path, F.col("date"))
        _WRITTEN[key] = path
    return S.read_documents(t.spark, _WRITTEN[key])


@query("s06_available_dates", with_views("select day, count(*) as n from documents_doc group by day", "documents_doc"))
def _(t):
    docs = doc_store(t)
    return S.available_dates(docs).join(docs.groupBy("day").agg(F.count("*").alias("n")), "day")


@query("s06_ids_of_date", with_views("select submission_id from documents_doc where day = '20240105'", "documents_doc"))
def _(t):
    return S.ids_of_date(doc_store(t), "20240105").select(F.col("submission_id").cast("bigint").alias("submission_id"))


@query("f03_date_range", with_views("select submission_id, day from documents_doc where day between '20240105' and '20240120' and day >= '20240110'", "documents_doc"))
def _(t):
    found = S.in_date_range(doc_store(t), "20240105", "20240120", resume_from="20240110")
    return found.select(F.col("submission_id").cast("bigint").alias("submission_id"), "day")


@query("f04_look_back", "select event_id, event_type from events where ts >= timestamp '2024-01-28 12:00:00' - interval 168 hour order by ts desc, event_id desc limit 500")
def _(t):
    ref = F.lit("2024-01-28 12:00:00").cast("timestamp_ntz")
    return S.look_back(t.events, ref, hours=168, limit=500, key="event_id").select("event_id", "event_type")


@query("f14_document_validation", with_views(
    """select submission_id, title_ok, array_to_string(list_filter([case when n = 0 then 'Empty required field: comments' end,
        case when n = 0 then 'Comments list is empty' end, case when n > 0 and not body_first then 'First comment entry should be submission body' end,
        case when bad_date then 'Invalid date format: ' || date end], lambda x: x is not null), '|') as issues,
        array_to_string(list_filter([case when date = '' then 'Empty field: date' end,
        case when malformed > 0 then malformed || ' comment threads don''t follow expected format' end,
        case when length(submission_id) < 5 or length(submission_id) > 10 then 'Unusual submission ID length: ' || submission_id end], lambda x: x is not null), '|') as warnings
        from (select cast(submission_id as varchar) as submission_id, true as title_ok, len(parts) as n, parts[1] like 'Submission body:%' as body_first,
         len(list_filter(parts[2:], lambda p: not starts_with(p, 'Top level comment:'))) as malformed,
         case when submission_id % 5 = 0 then '' when submission_id % 7 = 0 then 'yesterday' else '2024-01-05T10:00:00' end as date,
         submission_id % 5 = 0 or submission_id % 7 = 0 as bad_date
         from (select submission_id, list_prepend('Submission body: x', list_transform(parts, lambda p, i: case when i % 2 = 0 then 'Top level comment: ' || p else p end)) as parts from documents_doc))""",
    "documents_doc"))
def _(t):
    lines = F.transform("parts", lambda p, i: F.when((i + 1) % 2 == 0, F.concat(F.lit("Top level comment: "), p)).otherwise(p))
    docs = t.documents_doc.select(
        F.col("submission_id").cast("string").alias("submission_id"), F.lit("t").alias("title"), "subreddit",
        F.concat(F.array(F.lit("Submission body: x")), lines).alias("comments"),
        F.when(F.col("submission_id") % 5 == 0, "").when(F.col("submission_id") % 7 == 0, "yesterday").otherwise("2024-01-05T10:00:00").alias("date"))
    return S.validate(docs).select("submission_id", F.lit(True).alias("title_ok"), F.array_join("issues", "|").alias("issues"),
                                   F.array_join("warnings", "|").alias("warnings"))


@query("f14_missing_fields", """select doc_id, array_to_string(case when doc_id % 2 = 0 then ['comments'] else ['title', 'comments'] end, ',') as missing, false as is_valid
 from documents""")
def _(t):
    raw = t.documents.select("doc_id", F.to_json(F.struct(
        F.col("doc_id").alias("submission_id"), F.when(F.col("doc_id") % 2 == 0, F.lit("t")).alias("title"), F.col("source").alias("subreddit"),
    )).alias("value"))
    out = S.missing_fields(raw, ["submission_id", "title", "subreddit", "comments"])
    return out.select("doc_id", F.array_join("missing_fields", ",").alias("missing"), "is_valid")


@query("a21_daily_counts", with_views(
    "select day as date, subreddit, count(*) as n_submission, sum(len(parts))::bigint as n_comments from documents_doc group by 1, 2", "documents_doc"))
def _(t):
    docs = t.documents_doc.select(F.col("day").alias("date"), "subreddit", F.col("parts").alias("comments"))
    return S.comment_counts(docs)


@query("c24_comment_count", """select doc_id, case doc_id % 3 when 0 then 2 when 1 then 1 else 0 end as n from documents""")
def _(t):
    raw = (F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array(F.lit("a"), "text")))
           .when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.col("text").alias("v"))))
           .otherwise('""'))
    return t.documents.select("doc_id", I.json_array_size(raw).alias("n"))


# ------------------------------------------------------------- ids and dates

@query("c14_date_formats", with_views(
    f"""select l.link, strftime(to_timestamp(1500000000 + length(l.link) * 86411) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') as iso,
        strftime(to_timestamp(1500000000 + length(l.link) * 86411) at time zone 'UTC', '%Y%m%d') as day,
        coalesce(strftime({_TS}, '%Y-%m-%dT%H:%M:%S'), created) as created_iso, coalesce(strftime({_TS}, '%Y%m%d'), 'unknown_date') as folder
        from csv_submissions l""", "csv_submissions"))
def _(t):
    epoch = F.lit(1500000000) + F.length("link") * 86411
    return t.csv_submissions.select("link", I.epoch_to_iso(epoch).alias("iso"), I.epoch_to_day(epoch).alias("day"),
                                    I.iso_or_raw(F.col("created")).alias("created_iso"), I.day_or_unknown(F.col("created")).alias("folder"))


@query("c15_safe_names", r"""select page_id, case when s = '' then 'unnamed' when length(s) > 200 then substr(s, 1, 183) || '-' || substr(md5(s), 1, 16) else s end as name from (
 select page_id, trim(regexp_replace(html, '[/\\:*?"<>|\n\r\t]', '_', 'g'), '. ') as s from (select page_id, '. ' || url || html || ' .' as html from pages))""")
def _(t):
    raw = F.concat(F.lit(". "), "url", "html", F.lit(" ."))
    return t.pages.select("page_id", T.safe_path_value(raw).alias("name"))


@query("c16_request_ids", with_views(
    r"""select id, case when regexp_matches(id, '^\d{8}_[^_]+_c\d+$') then regexp_extract(id, '^(\d{8})_([^_]+)_c\d+$', 1) end as date,
        case when regexp_matches(id, '^\d{8}_[^_]+_c\d+$') then regexp_extract(id, '^(\d{8})_([^_]+)_c\d+$', 2) end as sid
        from (select day || '_' || case when submission_id % 9 = 0 then 'bad_' else '' end || submission_id || '_c' || (len(parts) - 1) as id from documents_doc)""",
    "documents_doc"))
def _(t):
    sid = F.concat(F.when(F.col("submission_id") % 9 == 0, "bad_").otherwise(""), F.col("submission_id").cast("string"))
    made = t.documents_doc.select(I.request_id(F.col("day"), sid, F.size("parts") - 1).alias("id"))
    date, parsed = I.parse_request_id(F.col("id"))
    return made.select("id", date.alias("date"), parsed.alias("sid"))


@query("c17_prompt_text", with_views(
    f"""select submission_id, {_sig("'Title: ' || subreddit || chr(10) || 'Body: ' || coalesce(nullif(parts[1], ''), 'No submission body') || chr(10) || 'Comments: ' || coalesce(nullif(parts[2], ''), 'No comments')")}
        from documents_doc""", "documents_doc"))
def _(t):
    made = T.prompt(TEMPLATE, F.col("subreddit"), F.try_element_at("parts", F.lit(1)), F.try_element_at("parts", F.lit(2)))
    return t.documents_doc.select("submission_id", *sig(made))


@query("c18_labelling_text", f"""
select doc_id, {_sig("case when length(f) > 600 then (case when nl > 480 then substr(f, 1, nl) else substr(f, 1, 600) end) || chr(10) || '[TEXT TRUNCATED]' else f end")},
 length(f) > 600 as was_cut from (select doc_id, f, case when instr(reverse(substr(f, 1, 600)), chr(10)) > 0 then 600 - instr(reverse(substr(f, 1, 600)), chr(10)) else -1 end as nl
 from (select doc_id, 'title: ' || substr(text, 1, 20) || chr(10) || 'body: ' || text || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || source as f from documents))""")
def _(t):
    text, cut = T.labelling_text({"lang": F.col("lang"), "title": F.substring("text", 1, 20), "body": F.col("text"), "source": F.col("source")}, 600)
    return t.documents.select("doc_id", *sig(text), cut.alias("was_cut"))


@query("c22_money", "select o_orderkey, '$' || printf('%.2f', o_totalprice) as money, o_totalprice as amount from orders")
def _(t):
    money = I.double_to_money(F.col("o_totalprice"))
    return t.orders.select("o_orderkey", money.alias("money"), I.money_to_double(money).alias("amount"))


@query("c23_date_sequence", with_views(
    """select source, strftime(unnest(generate_series(d0, d1, interval 1 day)), '%Y%m%d') as day from (select source,
        date '2024-01-01' + cast(min(doc_id) % 28 as int) as d0, date '2024-02-01' + cast(max(doc_id) % 28 as int) as d1 from documents group by source)"""))
def _(t):
    bounds = t.documents.groupBy("source").agg(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.min("doc_id") % 28).cast("int")), "yyyyMMdd").alias("d0"),
        F.date_format(F.date_add(F.lit("2024-02-01").cast("date"), (F.max("doc_id") % 28).cast("int")), "yyyyMMdd").alias("d1"))
    days = F.sequence(I.day_to_date(F.col("d0")), I.day_to_date(F.col("d1")))
    return bounds.select("source", F.explode(days).alias("day")).withColumn("day", F.date_format("day", "yyyyMMdd"))


@query("s02_dump_projection", with_views(
    """select 'u/' || author as author, score, strftime(to_timestamp(created_utc) at time zone 'UTC', '%Y-%m-%d %H:%M') as created,
        coalesce('https://www.reddit.com' || permalink, 'https://www.reddit.com/r/' || subreddit || '/comments/' || substr(link_id, 4) || '/_/' || id || '/') as link,
        md5(coalesce(selftext, '')) as digest, url from dump_lines""", "dump_lines"))
def _(t):
    out = U.project_dump(t.dump_lines, "submission")
    return out.select("author", "score", "created", "link", F.md5("text").alias("digest"), "url")

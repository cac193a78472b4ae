from pyspark.sql import functions as F

import pytest
from tidemark.functions import ids as I, text as T
from tidemark.operators import dump as D, threads as H
from tidemark.sources import consensus_store as CS, labels as L, requests as R, results_store as RS


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


def test_text_cleaning(spark):
    assert one(spark, "a&amp;lt;  b\n\tc ", T.clean_dump_text) == "a< b c"
    assert one(spark, "[removed]", T.clean_dump_text) == ""
    assert one(spark, "see [this](http://x.y) /u/bob &eacute;&#233;", lambda c: T.clean_comment(c, user_mentions=True)) == "see [this]( éé"
    assert one(spark, "abcdef", lambda c: T.truncate(c, 5)) == "ab..."
    assert one(spark, "lol.", T.is_low_quality) and not one(spark, "three good words", T.is_low_quality)


def test_links_and_times(spark):
    assert one(spark, "https://www.reddit.com/r/a/comments/iqn31w/title/g4/", I.submission_id_from_link) == "iqn31w"
    assert one(spark, "https://www.reddit.com/r/a/", I.submission_id_from_link) is None
    assert [one(spark, v, I.hours_from_text) for v in ("24h", "7d", "5")] == [24, 168, 5]
    assert one(spark, "$1,234.50", I.money_to_double) == 1234.5


def comments(spark, n, sub="s"):
    return spark.createDataFrame([(sub, i, (i * 7) % 11, "a", "c", f"t{i}", f"l{i}") for i in range(n)],
                                 "submission_id string, file_pos long, score long, author string, created string, body string, link string")


def test_cap_keeps_file_order_below_and_best_above(spark):
    below = D.cap_comments(comments(spark, 5), 5).orderBy("place").collect()
    assert [r.file_pos for r in below] == [0, 1, 2, 3, 4]
    above = D.cap_comments(comments(spark, 30), 5).orderBy("place").collect()
    want = sorted(range(30), key=lambda i: (-((i * 7) % 11), i))[:5]
    assert [r.file_pos for r in above] == want


def test_large_caps_rank_in_slices_first(spark):
    many = comments(spark, 1500).unionByName(comments(spark, 1100, "t"))
    got = D.cap_comments(many, 1200).groupBy("submission_id").agg(F.count("*").alias("n"), F.min("file_pos").alias("lo")).collect()
    assert {r.submission_id: r.n for r in got} == {"s": 1200, "t": 1100}
    kept = {r.file_pos for r in D.cap_comments(many, 1200).where("submission_id = 's'").collect()}
    assert kept == set(sorted(range(1500), key=lambda i: (-((i * 7) % 11), i))[:1200])


def test_years_and_orphans(spark):
    subs = spark.createDataFrame([("2019-01-01 00:00", "/comments/a/"), ("bad", "/comments/b/"), (None, "/comments/c/"), ("2021-01-01 00:00", "/comments/d/")], "created string, link string")
    kept = D.filter_years(subs)
    assert {r.link for r in kept.collect()} == {"/comments/b/", "/comments/d/"}
    coms = spark.createDataFrame([("/comments/a/x/1",), ("/comments/d/x/2",), (None,)], "link string")
    assert [r.submission_id for r in D.drop_orphans(coms, kept).collect()] == ["d"]


def chain(n):
    return [("s", f"c{i}", i, "t3_s" if i == 0 else f"t1_c{i - 1}", f"b{i}", i) for i in range(n)]


SCHEMA = "submission_id string, id string, pos long, parent_id string, body string, score int"


def test_deep_threads_orphans_and_circles(spark):
    rows = chain(70) + [("s", "o", 80, "t1_gone", "x", 0), ("s", "p", 81, "t1_o", "x", 0), ("s", "q", 82, "t1_r", "x", 0), ("s", "r", 83, "t1_q", "x", 0), ("s", "n", 84, "", "x", 0)]
    got = {r.id: r for r in H.locate_comments(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["c69"].root == "c0" and got["c10"].depth == 11 and got["c69"].depth == 70
    assert got["o"].root is None and got["o"].depth == 0 and got["p"].depth == 1
    assert got["q"].root is None and got["q"].depth is None and got["n"].depth == 0


def test_depth_limit_is_an_option(spark):
    got = H.locate_comments(spark.createDataFrame(chain(70), SCHEMA), depth_cap=50)
    assert got.agg(F.max("depth")).first()[0] == 50


def test_all_comments_are_kept_without_a_cap(spark):
    subs = spark.createDataFrame([("a", "t", 1, "2021-01-01 00:00", "/comments/s/x/", "", "u", "r")],
                                 "author string, title string, score long, created string, link string, text string, url string, subreddit string")
    doc = D.build_documents(subs, comments(spark, 1500)).first()
    assert len(doc.comments) == 1500 and doc.comments[7].startswith("Top level comment: t7 ")


def test_thread_text_is_depth_first(spark):
    rows = [("s", "a", 0, "t3_s", "A", 1), ("s", "b", 1, "t1_a", "B", 2), ("s", "c", 2, "t1_a", "C", 3), ("s", "d", 3, "t1_b", "D", 4),
            ("s", "e", 4, "t1_d", " ", 5), ("s", "f", 5, "t1_e", "F", 6), ("s", "g", 6, "t3_s", "", 7)]
    got = H.thread_texts(H.locate_comments(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [r.thread for r in got] == ["Top level comment: A (score 1); Replies: B (score 2); D (score 4); F (score 6); C (score 3)"]


def test_bad_labels_fail(spark):
    import pytest

    raw = spark.createDataFrame([("a", "2")], "submission_id string, label string")
    with pytest.raises(Exception, match="Label must be 0 or 1"):
        L.normalise_labels(raw).collect()


def test_packing_respects_both_limits(spark):
    docs = spark.range(300).selectExpr("cast(id as string) as submission_id", "if(id < 250, 'd1', 'd2') as day", "'t' as title",
                                       "repeat('x', cast(id % 90 as int)) as submission_body", "array('a', 'b', 'c') as comments")
    packed = R.pack_requests(R.build_requests(docs, "{title} {body} {comment}", "m"), max_requests=40, max_bytes=9000)
    bins = packed.groupBy("job").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.countDistinct("day").alias("d")).collect()
    assert sum(r.n for r in bins) == 900
    assert all(r.n <= 40 and r.b <= 9000 and r.d == 1 for r in bins)


def test_an_oversized_request_takes_no_room_from_others(spark):
    docs = spark.range(200).selectExpr("cast(id as string) as submission_id", "'d' as day", "'t' as title", "if(id = 7, repeat('x', 20000), 'b') as submission_body", "array('a') as comments")
    packed = R.pack_requests(R.build_requests(docs, "{title} {body} {comment}", "m"), max_requests=1000, max_bytes=9000).cache()
    bins = packed.groupBy("job").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.max("oversized").alias("o")).collect()
    assert [(r.n, r.o) for r in bins if r.b > 9000] == [(1, True)]
    total = packed.where("not oversized").agg(F.sum("bytes")).first()[0]
    assert len(bins) - 1 <= 1.1 * total / 9000 + 2  # the job before the oversized one ends early
    across = R.pack_requests(R.build_requests(docs.withColumn("day", F.col("submission_id")), "{title} {body} {comment}", "m"), 1000, 9000, per_day=False)
    assert across.select("job").distinct().count() < 20


@pytest.mark.parametrize("per_day, limit, room", ((True, 40, 900), (False, 1000, 3700)))
def test_jobs_are_cut_where_one_pass_cuts_them(spark, per_day, limit, room):
    """Sizes just below, at and above the limit, and repeated ids."""
    import random

    rng = random.Random(limit)
    rows = [(f"d{rng.randrange(3)}", f"s{k // 3:03d}", k % 3, f"id{k % 97}", "x" * rng.choice((1, 50, 300, room % 1000 - 1, room % 1000, room % 1000 + 1, 2000)))
            for k in range(200)]
    df = spark.createDataFrame(rows, "day string, submission_id string, i int, custom_id string, line string").withColumn("prompt", F.col("line"))
    got = R.pack_requests(df, limit, room, per_day)
    want, jobs, state = [], {}, None
    for day, sub, i, cid, line in sorted(rows, key=lambda r: r[:3]):
        span = day if per_day else "all"
        if state is None or state[0] != span:
            state = [span, 0, 0]
            jobs[span] = -1
            fresh = True
        else:
            fresh = state[1] + 1 > limit or state[2] + len(line) > room
        if fresh:
            jobs[span] += 1
            state[1:] = [0, 0]
        state[1] += 1
        state[2] += len(line)
        want.append((day, sub, i, cid, len(line), f"{span}-{jobs[span]}" if per_day else str(jobs[span]), len(line) > room))
    assert sorted(map(tuple, got.select("day", "submission_id", "i", "custom_id", "bytes", "job", "oversized").collect())) == sorted(want)


def forest(seed, n):
    """Replies in any order, orphans, a circle, a comment that answers itself, a deep chain and repeated rows."""
    import random

    rng = random.Random(seed)
    rows = []
    for s in (1, 2):
        for i in range(n):
            up = f"t1_c{rng.randrange(i)}" if i and rng.random() < 0.8 else "t3_x" if rng.random() < 0.8 else "t1_gone"
            rows.append((s, f"c{i}", up, rng.randrange(10**6), f"b{i}", i))
        rows += [(s, f"d{i}", f"t1_d{i - 1}" if i else "t3_x", i, "", 0) for i in range(12)]
    rows += [(1, "x1", "t1_x2", 1, "", 0), (1, "x2", "t1_x1", 2, "", 0), (1, "x3", "t1_x2", 2, "", 0), (1, "self", "t1_self", 5, "", 0), (1, "none", None, 6, "", 0)]
    rng.shuffle(rows)
    return rows


def test_places_equal_a_walk_through_the_trees(spark):
    rows = forest(3, 40)
    got = H.locate_comments(spark.createDataFrame(rows + rows[:3], "submission_id long, id string, parent_id string, pos long, body string, score int"))
    assert {f.dataType.typeName() for f in got.schema.fields} <= {"long", "string", "integer"}  # fixed-size rows
    want, below, known = {}, {}, {(r[0], r[1]) for r in rows}
    for s, i, up, pos, *_ in rows:
        if up and up.startswith("t1_") and (s, up[3:]) in known:
            below.setdefault((s, up[3:]), []).append((pos, i))
    for s, i, up, *_ in rows:
        if not (up and up.startswith("t1_") and (s, up[3:]) in known):
            top = bool(up) and up.startswith("t3_")
            work, rank = [(i, int(top))], 0
            while work:
                at, depth = work.pop()
                want[s, at] = (i if top else None, rank, depth)
                rank += 1
                work += [(c, depth + 1) for _pos, c in sorted(below.get((s, at), []), reverse=True)]
    found = [((r.submission_id, r.id), (r.root, r["rank"], r.depth)) for r in got.collect()]
    assert len(found) == len(rows) + 3
    assert all(place == want.get(key, (None, None, None)) for key, place in found)
    assert sum(key not in want for key, _ in found) == 4


def test_entities_equal_the_standard_decoder(spark):
    """All names with and without what follows, numbers of every kind, and text around them."""
    import html
    import random
    from html.entities import html5

    rng = random.Random(1)
    names = sorted(html5)
    cases = ["", "&", "&&", "no entity", "&amp;lt;", "&notit;", "&#", "&#;", "&#x;", "&#xg", "a & b", "&#0;", "&#00065;x", "&#x0000041", "&#99999999999999999999;",
             "&#xD800;", "&#x110000;", "&#65534;", "&#x1FFFF;", "&ampere &copycat", "&#128;&#x9f;&#129", "&\n;", "&gt&lt", "\U0001f600&#x1F600;&#128512x"]
    cases += [f"a&{n}" for n in names] + [f"&{n}1 &{n.rstrip(';')}=b" for n in rng.sample(names, 400)]
    cases += [f"&#{n};" for n in [*range(0, 300), 2047, 2048, 65535, 65536, 64975, 64976, 65007, 65008]] + [f"&#x{n:X}" for n in rng.sample(range(1 << 21), 300)]
    cases += ["".join(rng.choice(["&", "#", "x", "1", "9", ";", "amp", "lt", "no", "t", " ", "é"]) for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(cases)) + [(-1, None)], "i int, t string").select("i", T.decode_all_entities("t").alias("d"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.d for r in df.collect()}
    assert got.pop(-1) is None
    assert [(cases[i], d) for i, d in sorted(got.items()) if d != html.unescape(cases[i])] == []


def test_output_lines_drop_bad_rows(spark):
    good = '{\\"primary_ticker\\":null,\\"sentiments\\":[{\\"confidence\\":7,\\"ticker\\":\\"$aa\\",\\"is_implicit\\":false,\\"sentiment\\":\\"bullish\\",\\"sentiment_intensity\\":5,\\"position\\":\\"calls\\",\\"conviction\\":\\"high\\",\\"time_horizon\\":\\"day\\",\\"source\\":\\"both\\",\\"explanation\\":\\"x\\",\\"extraction_refusal\\":false}]}'

    def line(cid, args):
        return f'{{"custom_id":"{cid}","response":{{"body":{{"choices":[{{"message":{{"tool_calls":[{{"function":{{"arguments":"{args}"}}}}]}}}}]}}}}}}'

    lines = [line("20240101_s_c0", good), line("oops", good), line("20240101_s_c1", good[:40]), line("20240101_s_c2", good.replace("bullish", "maybe")),
             '{"custom_id":"20240101_s_c3","response":{"body":{"error":"busy"}}}']
    got = R.flatten_opinions(R.parse_outputs(spark.createDataFrame([(v,) for v in lines], "value string"))).collect()
    assert [(r.submission_id, r.ticker) for r in got] == [("s", "AA")]


def test_score_features_are_linear_in_comments(spark):
    import time

    from tidemark.operators import features as M

    def seconds(n):
        docs = spark.range(1).select(F.col("id").alias("submission_id"), F.lit("t").alias("title"), F.transform(
            F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("Top level comment: x (score "), (i % 11).cast("string"), F.lit(")"))).alias("comments"))
        start = time.perf_counter()
        row = M.extract(docs, {"e": M.engagement_features}).select("avg_comment_score", "score_variance", "high_score_comments").first()
        return time.perf_counter() - start, row

    seconds(100)
    took, row = seconds(22_000)
    assert took < 10 and abs(row.avg_comment_score - 5) < 1e-9 and abs(row.score_variance - 10) < 1e-9 and row.high_score_comments == 12_000


def test_latest_state_decides(spark):
    log = spark.createDataFrame([(1, "failed", "a", 1), (1, "processed", "b", 2), (2, "processed", "a", 1), (2, "failed", "b", 2), (3, "failed", "a", 1), (3, "processed", "b", 1)],
                                "submission_id long, status string, session_id string, ts long")
    available = spark.createDataFrame([(i, "d") for i in (1, 2, 3, 4)], "submission_id long, date string")
    assert {r.submission_id for r in RS.to_do(available, log).collect()} == {4}
    assert {r.submission_id for r in RS.to_do(available, log, retry_failed=True).collect()} == {2, 4}
    assert {r.submission_id for r in RS.retry_subset(log, available).collect()} == {2}
    day = RS.progress(available, log).first()
    assert (day.total_found, day.processed, day.failed, day.remaining) == (4, 2, 1, 1)


def test_long_names_stay_apart(spark):
    a, b = "x" * 300, "x" * 299 + "y"
    assert one(spark, a, T.safe_path_value) != one(spark, b, T.safe_path_value) and len(one(spark, a, T.safe_path_value)) == 200


def test_old_days_are_dropped(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", "A", 1), ("2024-02-01", "A", 2)], "date string, ticker string, n int").withColumn("date", F.to_date("date"))
    CS.write_days(rows, str(tmp_path / "s"))
    assert CS.drop_old_days(spark, str(tmp_path / "s"), "2024-01-15") == 1
    assert [r.n for r in CS.read_store(spark, str(tmp_path / "s")).collect()] == [2]

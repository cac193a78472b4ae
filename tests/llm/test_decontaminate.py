import re

import pytest

from tidemark.llm import decontaminate as D

BENCH = [("a", "The quick brown fox jumps over the lazy dog while seven wizards brew strong potions tonight again"),
         ("b", "Short Item"), ("c", None), ("d", "..."), (None, "nameless item here"), ("e", "short item"), ("f", "é Ü漢 wort")]
DOCS = [
    (1, "so THE quick brown fox jumps over the lazy dog while seven wizards brew strong potions tonight again ends"),
    (2, "a short, item and nothing else " + "filler " * 50), (3, "the quick brown fox jumps over the lazy cat"), (4, None), (5, ""),
    (6, "short-item short item"), (7, "É Ü漢 wort"), (8, "é Ü漢 Wort"), (9, "nameless ITEM here"), (10, "!!short item!!"), (10, "!!short item!!"), (11, "word " * 4000)]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text):
    w, hit, items = words(text), set(), set()
    for item, bench in BENCH:
        b = words(bench)
        for i in range(max(1, len(b) - 12) if b else 0):
            g = b[i:i + 13]
            for p in range(len(w) - len(g) + 1):
                if w[p:p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    items |= {item} if item else set()
    return len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", (1 << 20, 0))
def test_equals_brute_force_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in D.find_contamination(docs, bench).collect())
    assert got == sorted((i, *brute(t)) for i, t in DOCS)


def test_removal(spark, docs, no_docs):
    table = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    left = {r.doc_id for r in D.remove_contamination(table, bench).collect()}
    assert left == {i for i, t in DOCS if not brute(t)[3]}
    cut = {r.doc_id: r.text for r in D.remove_contamination(table, bench, "spans").collect()}
    assert cut[1] == "so ends" and cut[4] is None and cut[3] == DOCS[2][1] and cut[10] == "!!"
    assert all(not brute(t)[1] for t in cut.values() if t and len(t) < 1000)
    none = bench.limit(0)
    assert D.remove_contamination(docs, none).count() == docs.count() and D.remove_contamination(docs, none).columns == docs.columns
    assert D.find_contamination(no_docs, bench).count() == 0 and D.find_contamination(docs, none).where("contaminated").count() == 0


def test_items_that_share_windows_share_a_set(spark):
    text = " ".join(f"w{k}" for k in range(40))
    bench = spark.createDataFrame([(f"i{k:03d}", text) for k in range(200)] + [("z", "w1 w2 other")], "item_id string, text string")
    wins, sets = D.bench_windows(bench)
    assert wins.count() == 29 and sets.count() == 2 and wins.columns == ["b_key", "b_gram", "set"]
    docs = spark.createDataFrame([(k, text if k % 3 == 0 else f"own words {k}") for k in range(600)], "doc_id long, text string")
    for found in D.find_contamination(docs, bench).collect():
        want = (40, 40, 200, True) if found.doc_id % 3 == 0 else (3, 0, 0, False)
        assert (found.n_words, found.n_hit, found.n_items, found.contaminated) == want
    assert D.remove_contamination(docs, bench).count() == 400


def test_marks_have_many_keys_in_the_shuffled_form(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    rows = spark.range(2000).selectExpr("id as row", "array('a', 'b') as w")
    wins, _ = D.bench_windows(spark.createDataFrame([("q", "never here")], "item_id string, text string"))
    marks = D._hits(rows, wins, marks=True)
    assert marks.count() == 2000 and marks.where("gram_len = 0 and set is null and n_words = 2").count() == 2000
    keys = rows.select(D._mark(rows["row"], 16).alias("k")).groupBy("k").count().collect()
    assert len(keys) == 16 and max(k["count"] for k in keys) < 400

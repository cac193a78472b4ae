import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, quality

SMALL = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    bags = [rng.random((n, quality.WIDTH)) for n in (1, 3, 5)]
    y = np.array([1.0, 0.0, 1.0])
    model = quality.train(bags, y, epochs=2)
    x, doc = np.concatenate(bags), np.repeat(np.arange(3), [1, 3, 5])

    def loss():
        p = model.bags(x, doc)["score"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = model.gradients(model.bags(x, doc), y)
    for name, g in grads.items():
        flat = model.w[name].reshape(-1)
        for i in rng.integers(0, flat.size, 5):
            old, h = flat[i], 1e-5
            flat[i] = old + h
            up = loss()
            flat[i] = old - h
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * h) - g.reshape(-1)[i]) < 1e-6


def test_passages_of_texts():
    texts = ["one two three", None, "a " * 200, "", "É漢 x!"]
    (first, x, doc), = quality.encode(texts)
    assert first == 0 and np.bincount(doc).tolist() == [1, 1, 4, 1, 1] and np.isfinite(x).all()
    alone = np.concatenate([b[1] for t in texts for b in quality.encode([t])])
    assert np.allclose(alone, x)


def test_a_block_is_all_that_scoring_holds():
    """The check of the pipeline: with blocks of 2 MB two workers took an executor over its memory."""
    rng = np.random.default_rng(0)
    model = quality.train([rng.random((n, quality.WIDTH)) for n in (2, 3)], np.array([1.0, 0.0]), epochs=1)
    n, kinds = 1500, [None, "", "one two", "lorem ipsum, dolor 12 " * 150, "x" * 400_000]
    want = np.array([model.score(1, [t])[0] for t in kinds])
    sizes = [i % 4 for i in range(n)] + [4, 0, 3]
    assert sum(len(kinds[k] or "") for k in sizes) > 1_500_000
    assert np.allclose(model.score(len(sizes), (kinds[k] for k in sizes)), want[sizes])
    tracemalloc.start()
    model.score(n, (kinds[k] for k in sizes[:n]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    scored = quality.score_quality(docs, labels)
    assert scored.count() == docs.count()
    held = scored.where("held_out").join(labels, "doc_id").toPandas()
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == scored.where("predicted = 1").count()
    rest = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = quality.score_quality(docs, rest).toPandas().sort_values("doc_id").score.to_numpy()
    assert np.allclose(changed, scored.toPandas().sort_values("doc_id").score.to_numpy())


def test_quality_edge_cases(docs, no_docs, spark):
    labels = spark.createDataFrame([(3, 1), (9, 0), (9, None), (None, 1), (11, 1), (777, 0)], "doc_id long, quality int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    scores = {r.doc_id: r.score for r in rows if r.doc_id is not None}
    assert scores[0] == scores[1] and scores[9] == scores[10]
    assert quality.score_quality(no_docs, labels).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def auc(score, label):
    good, bad = score[label == 1], score[label == 0]
    return ((good[:, None] > bad).sum() + 0.5 * (good[:, None] == bad).sum()) / (len(good) * len(bad))


def test_held_out_ranking(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    held = quality.score_quality(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.9


def trained_on(monkeypatch, docs, labels, **bounds):
    """Bags and labels that reach the training."""
    seen = {}

    def keep(bags, y, **_kw):
        seen.update(bags=bags, y=list(y))

    monkeypatch.setattr(quality, "train", keep)
    quality.fit(docs, labels, **bounds)
    return seen


def test_sampled_texts_train_whole(spark, monkeypatch):
    """A short bad passage in a very long text is in its bag."""
    words = ["word"] * 64 * 400
    words[64 * 333:64 * 334] = ["%%%"] * 64
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5][:3]
    docs = spark.createDataFrame([(ids[0], " ".join(words)), (ids[1], "a b c"), (ids[2], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    got = trained_on(monkeypatch, docs, labels)
    sizes = {len(b): b for b in got["bags"]}
    assert sorted(len(b) for b in got["bags"]) == [1, 1, 400]
    odd = np.abs(sizes[400] - sizes[400][0]).sum(axis=1)
    assert np.flatnonzero(odd > 0).tolist() == [333]


def test_sample_bounds(spark, monkeypatch):
    """Labels without a document take no room, an id trains once, and passages are bounded by whole documents."""
    ids = [i for i in range(1, 4000) if zlib.crc32(str(i).encode()) % 5][:200]
    docs = spark.createDataFrame([(i, "w " * (64 * 5 if i == ids[7] else 10)) for i in ids[:20]], "doc_id long, text string")
    docs = docs.unionByName(docs).unionByName(docs.limit(5).selectExpr("doc_id", "'other text' as text"))
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    got = trained_on(monkeypatch, docs, labels, sample=20)
    assert len(got["bags"]) == 20
    tight = trained_on(monkeypatch, docs, labels, sample=20, passages=19)
    assert sum(len(b) for b in tight["bags"]) <= 19 and len(tight["bags"]) >= 15
    without = trained_on(monkeypatch, docs, labels, sample=20, passages=4)
    assert [len(b) for b in without["bags"]] == [1] * 4


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plans_hold_exactly_the_histogram(histogram):
    plan = packing.plan_packing(histogram, 64, rounds=40)
    held = Counter()
    for config, n in plan:
        assert sum(config) <= 64 and n > 0
        for length in config:
            held[length] += n
    assert held == Counter(histogram)
    total = sum(k * v for k, v in histogram.items())
    assert sum(n for _, n in plan) <= 2 * -(-total // 64) + 1


def test_the_program_places_nearly_all_of_many_lengths():
    count = np.array([0] + [40 + i % 7 for i in range(1000)] + [0] * 24)
    total = sum(k * int(n) for k, n in enumerate(count))
    weights = packing.solve_configurations(count, 1024)
    assert sum(int(w) * sum(config) for config, w in weights.items()) > 0.9 * total
    plan, held = packing.plan_packing({k: int(n) for k, n in enumerate(count) if n}, 1024), Counter()
    for config, n in plan:
        held.update({k: n * m for k, m in Counter(config).items()})
    assert all(held[k] == n for k, n in enumerate(count)) and sum(n for _, n in plan) <= 1.01 * -(-total // 1024) + 1


def packed_is_whole(df, docs, room):
    rows = df.collect()
    reference = Tokenizer.from_file(TOKENIZER)
    reference.encode_special_tokens = True
    want = Counter()
    for r in docs.collect():
        ids = np.array(reference.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), room)):
            part = ids[at:at + room]
            want[(r.doc_id, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(sequences), sum(r.length for r in rows)


@pytest.mark.parametrize("room", (1024, 7))
def test_packing_round_trip(docs, no_docs, room):
    packed_is_whole(packing.pack(docs, TOKENIZER, room), docs, room)
    assert packing.pack(no_docs, TOKENIZER, room).count() == 0


def test_added_tokens_are_encoded_as_the_library_does(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x <|endoftext|><|endoftext|>\n\ny", "<|endoftext| > <|ENDOFTEXT|>", "  <|endoftext|>  " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reference, want = Tokenizer.from_file(TOKENIZER), set()
    for i, text in enumerate(texts):
        ids = np.array(reference.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        want |= {(i, at, len(ids[at:at + 64]), zlib.crc32(ids[at:at + 64].tobytes())) for at in range(0, len(ids), 64)}
    got = packing.pack(docs, TOKENIZER, 64).select("doc_id", "start", "length", "ids_crc32").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_packing_is_tight(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n, tokens = packed_is_whole(packing.pack(docs, TOKENIZER), docs, 1024)
    assert n <= 1.01 * -(-tokens // 1024) + 1

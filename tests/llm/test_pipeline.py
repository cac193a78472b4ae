import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
ROOM = 1024


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_exact(docs):
    """doc_ids that stay of (doc_id, text): longest text, then smallest id, per text without white space."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {min(g)[1] for g in groups.values()}


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near(docs):
    """Smallest doc_id of each component over fingerprints that differ in at most three bits."""
    prints = [(i, plain_print(t)) for i, t in docs]
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i for i in root if find(i) == i}


def plain_clean(docs, bench):
    """doc_ids with less than a twentieth of their words inside windows of 13 benchmark words."""
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))

    windows = {tuple(w[p:p + 13]) for w in map(split, bench) if w for p in range(max(1, len(w) - 12))}
    stay = set()
    for i, text in docs:
        w, hit = split(text), set()
        for n in {len(g) for g in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit.update(range(p, p + n))
        if not hit or 20 * len(hit) < len(w):
            stay.add(i)
    return stay


@pytest.fixture(scope="module")
def with_plants(spark, tmp_path_factory):
    """The small tables, their documents with planted copies, near copies, benchmark passages and nulls."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    bench = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    long = sorted((r for r in rows if r["text"]), key=lambda r: (-len(r["text"]), r["doc_id"]))[:20]
    texts = [long[0]["text"].replace(" ", "  "), long[1]["text"], long[2]["text"] + " end", long[3]["text"] + " " + max(bench, key=lambda t: len(t or "")),
             max(bench, key=lambda t: len(t or "")), None, "", long[4]["text"].upper(), long[5]["text"] * 5]
    top = max(r["doc_id"] for r in rows)
    rows += [{**rows[0], "doc_id": top + 1 + k, "text": t} for k, t in enumerate(texts)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_run_equals_plain_stages(spark, with_plants):
    docs = spark.read.parquet(f"{with_plants}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{with_plants}/benchmark.parquet").collect()]
    good = {r.doc_id for r in QUERIES["op5_quality"](spark, with_plants).collect() if r.predicted == 1}
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    stages = dict(corpus_pipeline.STAGES)
    for name, plain in (("exact_dedup", plain_exact), ("simhash_near_dedup", plain_near), ("benchmark_decontamination", lambda d: plain_clean(d, bench))):
        given = spark.createDataFrame(left, "doc_id long, text string")
        stay = plain(left)
        assert {r.doc_id for r in stages[name](spark, given, with_plants).collect()} == stay, name
        left = [d for d in left if d[0] in stay]
    pieces = defaultdict(list)
    filled = defaultdict(list)
    for r in corpus_pipeline.run(spark, with_plants).collect():
        pieces[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == {i for i, _ in left}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in left:
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [2], 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[at:at + r.length])
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(raw)) and (len(ids) > ROOM or r.length == len(ids))
            at += r.length
        assert at == len(ids)
    for runs in filled.values():
        assert [o for o, _ in sorted(runs)] == [sum(n for _, n in sorted(runs)[:k]) for k in range(len(runs))]
        assert sum(n for _, n in runs) <= ROOM


def test_stages_keep_columns_and_only_drop_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {tuple(r) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SMALL)
        assert left.columns == docs.columns
        now = {tuple(r) for r in left.collect()}
        assert now and now <= before
        docs, before = spark.createDataFrame(sorted(now), docs.schema), now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in before}


def test_empty_documents_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_each_operator_is_registered():
    assert {int(k[2:].split("_")[0]) for k in QUERIES if k != "pipeline"} == set(range(1, 14)) and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES)


def test_stages_take_nulls_repeated_rows_and_clashing_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES[1:4]:
        left = stage(spark, docs, SMALL)
        assert left.columns == docs.columns and 0 < left.count() <= docs.count(), name

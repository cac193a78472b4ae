"""Which keys a table holds, without reading the table.

Keys lie in hash buckets, one file per batch and bucket, and each file has a Bloom sketch. A batch tests
its keys against the sketches of their buckets and opens only the files that may hold one of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tidemark.session import cut_lineage
from tidemark.streaming.jobs import stored, write_batch

BUCKETS, BITS_PER_KEY, PROBES = 16, 20, 10  # one false hit in some ten thousand keys
LEAST_BITS = 4096  # probes of one key would meet each other in less
_SKETCH = "bucket int, n_keys long, sketch binary, batch int"


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Positions of each hash in a sketch of ``bits`` bits."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)


def make_sketch(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(LEAST_BITS, -(-len(hashes) * BITS_PER_KEY // 8) * 8), dtype=np.uint8)
    if len(hashes):
        bits[_probes(hashes, len(bits)).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_hold(sketch: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(sketch, dtype=np.uint8))
    return bits[_probes(hashes, len(bits))].all(axis=1)


def _sketches(keyed: DataFrame) -> DataFrame:
    def build(key, rows):
        return pd.DataFrame({"bucket": [key[0]], "n_keys": [len(rows)], "sketch": [make_sketch(rows["h"].to_numpy(np.int64))]})

    return keyed.select("bucket", "h").groupBy("bucket").applyInPandas(build, "bucket int, n_keys long, sketch binary")


def _hits(keyed: DataFrame, sketches: DataFrame) -> DataFrame:
    """(bucket, batch, h) of every key that a file's sketch may hold."""
    def test(key, rows, files):
        hashes, found = rows["h"].to_numpy(np.int64), []
        for batch, sketch in zip(files["batch"], files["sketch"]):
            hit = hashes[may_hold(sketch, hashes)] if len(hashes) else hashes
            found.append(pd.DataFrame({"bucket": key[0], "batch": batch, "h": hit}))
        return pd.concat(found) if found else pd.DataFrame({"bucket": [], "batch": [], "h": []})

    return keyed.select("bucket", "h").groupBy("bucket").cogroup(sketches.groupBy("bucket")).applyInPandas(
        test, "bucket int, batch int, h long")


def with_hash(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("h", F.xxhash64(*key)).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))


def files_to_open(rows: DataFrame, path: str, key: list[str], batch: int, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """(batch, bucket) of the key files that may hold a key of ``rows``; at most one per file."""
    sketches = stored(rows.sparkSession, f"{path}-index/sketches", _SKETCH)
    if sketches is None:
        return []
    hits = _hits(with_hash(rows, key, buckets), sketches.where(F.col("batch") != batch))
    return sorted((r.batch, r.bucket) for r in hits.select("batch", "bucket").distinct().collect())


def known_keys(rows: DataFrame, path: str, key: list[str], batch: int, buckets: int = BUCKETS) -> DataFrame | None:
    """Stored keys in the files that may hold keys of ``rows``; None where no file may."""
    files = files_to_open(rows, path, key, batch, buckets)
    if not files:
        return None
    root = f"{path}-index/keys"
    folders = [f"{root}/batch={b}/bucket={k}" for b, k in files]
    return rows.sparkSession.read.schema(StructType([rows.schema[k] for k in key])).parquet(*folders)


def new_only(path: str, key: list[str], partition_by: list[str] = [], buckets: int = BUCKETS):
    """Batch handler: rows whose key is not stored yet are added, once each, however late they come.

    What exists is looked up in the index beside the table, so no watermark drops late rows or forgets old
    keys. A repeated batch replaces its own rows, keys and sketches. The index must be used with the number
    of buckets it began with.
    """

    def handle(rows: DataFrame, batch: int) -> None:
        fresh = cut_lineage(rows.dropDuplicates(key))
        known = known_keys(fresh, path, key, batch, buckets)
        if known is not None:
            same = [fresh[k].eqNullSafe(known[k]) for k in key]
            fresh = cut_lineage(fresh.join(known, same, "left_anti"))
        keyed = with_hash(fresh.select(*key), key, buckets)
        write_batch(keyed.select(*key, "bucket"), f"{path}-index/keys", batch, ["bucket"])
        write_batch(_sketches(keyed), f"{path}-index/sketches", batch)
        write_batch(fresh, path, batch, partition_by)

    return handle

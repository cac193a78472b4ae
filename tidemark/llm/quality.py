"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 64  # words of a passage
BUCKETS = 64  # hashed words
HIDDEN = 24
_BLOCK = 1 << 18  # bytes encoded at once; their vectors and hashes take some forty times that

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
_CLASS = np.zeros(256, dtype=np.int64)  # 0: control and white space
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:0xC0], _CLASS[0xC0:] = 1, 2, 3, 4, 5
_CLASS[_MARKS] = 6 + np.arange(len(_MARKS))
_CLASSES = 6 + len(_MARKS)
_SHAPE = 7
WIDTH = _CLASSES + BUCKETS + _SHAPE
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, from running sums of bytes times powers of an odd number."""
    powers = np.cumprod(np.full(len(raw), _PRIME, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers)])
    back = np.cumprod(np.full(len(raw), _INVERSE, dtype=np.uint64))
    mixed = (sums[ends] - sums[starts]) * back[starts] * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _encode_block(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)
    sizes = np.array([len(r) + 1 for r in raws])
    bounds = np.cumsum(sizes)
    white = _WHITE[raw]
    before = np.concatenate([[True], white[:-1]])
    starts = np.flatnonzero(~white & before)
    ends = np.flatnonzero(white & ~before)
    doc = np.searchsorted(bounds, starts, side="right")
    n_words = np.bincount(doc, minlength=len(raws))
    n_pass = np.maximum(1, -(-n_words // WORDS))
    first_pass = np.concatenate([[0], np.cumsum(n_pass)[:-1]])
    first_word = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    passage = first_pass[doc] + (np.arange(len(starts)) - first_word[doc]) // WORDS
    total = int(n_pass.sum())
    lengths = ends - starts
    words = np.maximum(1, np.bincount(passage, minlength=total))
    text = raw[~white]
    of_byte = np.repeat(passage, lengths)
    n_bytes = np.maximum(1, np.bincount(of_byte, minlength=total))
    out = np.zeros((total, WIDTH), dtype=np.float32)
    out[:, :_CLASSES] = np.bincount(of_byte * _CLASSES + _CLASS[text], minlength=total * _CLASSES).reshape(total, -1) / n_bytes[:, None]
    if len(starts):
        hashes = _word_hashes(raw, starts, ends)
        bucket = (hashes >> np.uint64(58)).astype(np.int64)
        out[:, _CLASSES:_CLASSES + BUCKETS] = np.bincount(passage * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, -1) / words[:, None]
        same = np.zeros(len(starts))
        same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
        order = np.lexsort((hashes, passage))
        new = np.ones(len(starts))
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
        letter = _CLASS[raw]
        marked = letter[ends - 1] >= 6
        bare = letter[starts] >= 6
        for k, values in enumerate((same, lengths / 10.0, (lengths / 10.0) ** 2, marked, bare, lengths == 1)):
            out[:, WIDTH - _SHAPE + k] = np.bincount(passage, weights=values, minlength=total) / words
        out[:, WIDTH - 1] = np.bincount(passage[order], weights=new, minlength=total) / words
    return out, np.repeat(np.arange(len(raws)), n_pass)


def encode(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first text, passage vectors, text of each passage within the block); empty texts have one passage."""
    block, first, size = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if block and size + len(raw) > _BLOCK:
            yield first, *_encode_block(block)
            block, first, size = [], i, 0
        block.append(raw)
        size += len(raw)
    if block:
        yield first, *_encode_block(block)


@dataclass
class AttentionModel:
    """Passage encoder, gated attention and document head."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def bags(self, x: np.ndarray, doc: np.ndarray) -> dict[str, np.ndarray]:
        """Forward pass; passages of a document are neighbours in ``doc``."""
        w = self.w
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(doc)]]))
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.tanh(x @ w["enc"] + w["enc_b"])
        v, u = np.tanh(z @ w["att"]), 1 / (1 + np.exp(-(z @ w["gate"] + w["gate_b"])))
        logit = (v * u) @ w["pick"]
        e = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        pooled = np.add.reduceat(a[:, None] * z, starts)
        score = 1 / (1 + np.exp(-np.clip(pooled @ w["head"] + w["head_b"], -30, 30)))
        return {"x": x, "z": z, "v": v, "u": u, "a": a, "pooled": pooled, "score": score, "starts": starts, "counts": counts}

    def gradients(self, f: dict[str, np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss, through head, attention and encoder."""
        w, n = self.w, len(y)
        d_logit = (f["score"] - y) / n
        d_pooled = d_logit[:, None] * w["head"][None, :]
        each = np.repeat(d_pooled, f["counts"], axis=0)
        d_a = (each * f["z"]).sum(1)
        mean = np.repeat(np.add.reduceat(f["a"] * d_a, f["starts"]), f["counts"])
        d_pick = f["a"] * (d_a - mean)
        d_vu = d_pick[:, None] * w["pick"][None, :]
        d_v = d_vu * f["u"] * (1 - f["v"] ** 2)
        d_u = d_vu * f["v"] * f["u"] * (1 - f["u"])
        d_z = f["a"][:, None] * each + d_v @ w["att"].T + d_u @ w["gate"].T
        d_h = d_z * (1 - f["z"] ** 2)
        return {"enc": f["x"].T @ d_h, "enc_b": d_h.sum(0), "att": f["z"].T @ d_v, "gate": f["z"].T @ d_u, "gate_b": d_u.sum(0),
                "pick": (f["v"] * f["u"]).T @ d_pick, "head": f["pooled"].T @ d_logit, "head_b": np.array([d_logit.sum()])}

    def score(self, n: int, texts) -> np.ndarray:
        """Scores of ``n`` texts, of which no more than a block is held."""
        out = np.zeros(n)
        for first, x, doc in encode(texts):
            scores = self.bags(x, doc)["score"]
            out[first:first + len(scores)] = scores
        return out


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.01, decay: float = 1e-4,
          seed: int = 7) -> AttentionModel:
    """Adam on the logistic loss; labels are of documents, the attention finds the passages that decide."""
    rng = np.random.default_rng(seed)
    n = sum(len(b) for b in bags)
    mean = sum(b.sum(0, dtype=np.float64) for b in bags) / n
    scale = np.sqrt(sum(((b - mean) ** 2).sum(0) for b in bags) / n) + 1e-3
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {"enc": draw(WIDTH, HIDDEN), "enc_b": np.zeros(HIDDEN), "att": draw(HIDDEN, HIDDEN), "gate": draw(HIDDEN, HIDDEN),
               "gate_b": np.zeros(HIDDEN), "pick": draw(HIDDEN), "head": draw(HIDDEN), "head_b": np.zeros(1)}
    model = AttentionModel(mean, scale, weights)
    m = {k: np.zeros_like(v) for k, v in weights.items()}
    s = {k: np.zeros_like(v) for k, v in weights.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        pace = rate * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            x = np.concatenate([bags[i] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
            grads = model.gradients(model.bags(x, doc), labels[part])
            step += 1
            for k, g in grads.items():
                g = g + decay * weights[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                weights[k] = weights[k] - pace * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def held_out(id_column: Column) -> Column:
    """A fifth of the ids, by the CRC-32 of the id as text; false for null ids."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(False))


def choose_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int, passages: int, id_col: str, text_col: str) -> list[tuple]:
    """(id, text hash, label) of the training rows: whole documents in the order of their id's hash.

    Labels of ids without a document, of held-out and of null ids do not count. The first ``sample`` ids are
    looked at; one goes in if its passages still fit into ``passages``, so both bounds hold and no text is cut.
    Of an id with several texts the one with the smallest hash trains. At most ``sample`` rows reach the driver.
    """
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(
        F.col(id_col).alias("lab_id")).agg(F.max(label_col).cast("double").alias("y"))
    there = told.join(docs.select(F.col(id_col).alias("lab_id")), "lab_id", "left_semi")
    order = [F.xxhash64("lab_id", F.lit("sample")), F.col("lab_id")]
    chosen = there.orderBy(*order).limit(sample)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("lab_id"), text.alias("text")).join(F.broadcast(chosen), "lab_id")
    sized = rows.select("lab_id", "y", F.xxhash64("text").alias("h"), F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).alias("n"))
    taken, left = [], passages
    for r in sized.groupBy("lab_id").agg(F.max("y").alias("y"), F.min(F.struct("h", "n")).alias("t")).orderBy(*order).collect():
        size = max(1, -(-r.t.n // WORDS))
        if size <= left:
            taken.append((r.lab_id, r.t.h, r.y))
            left -= size
    return taken


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 4000, passages: int = 1 << 17, id_col: str = "doc_id",
        text_col: str = "text") -> AttentionModel | None:
    """Train on a bounded sample of labelled rows outside the held-out fifth; None without labels.

    Every passage of a sampled document trains. Passages are encoded in tasks; the driver gets at most
    ``passages`` vectors, 57 MB at the default.
    """
    taken = choose_sample(docs, labels, label_col, sample, passages, id_col, text_col)
    if not taken:
        return None
    id_type = labels.schema[id_col].dataType.simpleString()
    picked = docs.sparkSession.createDataFrame(taken, f"lab_id {id_type}, h long, y double")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for first, x, doc in encode(batch["text"]):
                for i in range(doc[-1] + 1):
                    own = x[np.searchsorted(doc, i):np.searchsorted(doc, i, side="right")]
                    rows.append((batch["lab_id"].iloc[first + i], batch["y"].iloc[first + i], own.astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["lab_id", "y", "bag"])

    rows = docs.select(F.col(id_col).alias("lab_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    one = rows.join(F.broadcast(picked), ["lab_id", "h"]).groupBy("lab_id").agg(F.max("y").alias("y"), F.max("text").alias("text"))
    table = one.mapInPandas(bags, f"lab_id {id_type}, y double, bag binary").toPandas().sort_values("lab_id", kind="stable")
    return train([np.frombuffer(b, dtype="<f4").reshape(-1, WIDTH) for b in table["bag"]], table["y"].to_numpy())


def score_column(model: AttentionModel | None, text: Column) -> Column:
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(len(texts), (text.as_py() for text in texts)))  # one text at a time as a string

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality", sample: int = 4000,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; only the whole text is an input of the score.

    Null and empty texts have one passage without words and get its score. Without any label every score
    is 0.5. Repeated rows score alike; of several labels of one id the highest counts; extra columns are
    not read; no rows give no rows.
    """
    model = fit(docs, labels, label_col, sample, id_col=id_col, text_col=text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score_column(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality", sample: int = 4000,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns as they came."""
    model = fit(docs, labels, label_col, sample, id_col=id_col, text_col=text_col)
    return docs.where(score_column(model, F.col(text_col)) >= threshold)

"""Token counts by a dynamic program shared over a trie of pre-tokens."""

from __future__ import annotations

import base64
import math

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-token pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_KNOWN = 500_000  # distinct pre-tokens a worker remembers before it starts anew; bounds memory only
_MODELS: dict[str, "UnigramTrie"] = {}


def read_scores(vocabulary: str) -> dict[bytes, float]:
    """Unigram log-scores of a ranked vocabulary file (base64 piece, rank): Zipf's law over the rank.

    The vocabulary holds every single byte, so any text can be cut into its pieces.
    """
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - norm for piece, r in ranks.items()}


class UnigramTrie:
    """Counts of the best unigram cut of pre-tokens, with forward scores kept once per shared prefix.

    Distinct pre-tokens are inserted in sorted order, so the path from the root to the current word is all
    of the trie that is needed: nodes below the common prefix are dropped, those above keep their scores.
    A node holds the best score of its prefix and the number of pieces there; equal scores take fewer pieces.
    """

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.endings = {piece[i:] for piece in scores for i in range(len(piece))}  # where a piece may still begin further left
        self.known: dict[str, int] = {}
        self.steps = 0

    def learn(self, words: set[str]) -> None:
        """Terminal counts of all ``words``."""
        if len(self.known) + len(words) > MOST_KNOWN:
            self.known = {}
        scores, endings = self.scores, self.endings
        best, pieces, last = [0.0], [0], b""
        for word, text in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1:], pieces[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                top, count = -math.inf, 0
                for start in range(end - 1, -1, -1):
                    piece = word[start:end]
                    if piece not in endings:
                        break
                    score = scores.get(piece)
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and pieces[start] < count - 1:
                            top, count = score, pieces[start] + 1
                best.append(top)
                pieces.append(count)
            self.steps += len(word) - shared
            self.known[text] = pieces[-1]
            last = word


def _model(vocabulary: str) -> UnigramTrie:
    if vocabulary not in _MODELS:
        _MODELS[vocabulary] = UnigramTrie(read_scores(vocabulary))
    return _MODELS[vocabulary]


def counts_column(vocabulary: str):
    """Pre-tokens and tokens per text."""
    find = regex.compile(PATTERN).findall

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def counts(texts: pd.Series) -> pd.DataFrame:
        model = _model(vocabulary)
        n_pre, n_tok = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for at in range(0, len(texts), 256):  # a block's pre-tokens are held at once
            found = [find(t or "") for t in texts[at:at + 256]]
            fresh = set().union(*found) - model.known.keys() if found else set()
            if fresh:
                model.learn(fresh)
                missing = set().union(*found) - model.known.keys()  # forgotten when the memory was renewed
                if missing:
                    model.learn(missing)
            known = model.known
            for i, words in enumerate(found, at):
                n_pre[i] = len(words)
                n_tok[i] = sum(map(known.__getitem__, words))
        return pd.DataFrame({"n_pretokens": n_pre, "n_tokens": n_tok})

    return counts


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text under the best unigram cut: doc_id, n_bytes, n_pretokens, n_tokens.

    Each worker process keeps the terminal counts of the pre-tokens it has met, so a pre-token is cut once
    per process and shared prefixes once per sorted block; nothing is shuffled. Null and empty texts have
    no tokens. Repeated rows are counted each for itself; extra columns are not read; no rows give no rows.
    """
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
                          counts_column(vocabulary)(F.col(text_col)).alias("c"))
    return counted.select("doc_id", "n_bytes", "c.n_pretokens", "c.n_tokens")

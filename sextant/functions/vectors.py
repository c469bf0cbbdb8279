"""Vector functions: cosine by Column expressions, the hashing embedding in both forms."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different length and for zero vectors."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale)


def knn_score(cos: Column) -> Column:
    return (F.lit(1.0) + cos) / 2


def bucket_of(token: str, dim: int) -> int:
    """Bucket of a lower-case ASCII token: a polynomial hash (31, seed 1) in 32 signed bits, floor-modulo dim."""
    h = 1
    for ch in token.encode("ascii"):
        h = (h * 31 + ch) & MASK
    return (h - (1 << 32) if h >= 1 << 31 else h) % dim


def hash_counts(text: str | None, dim: int) -> list[int]:
    """How many tokens of a text fall into each bucket."""
    v = [0] * dim
    for t in re.split("[^a-z0-9]+", (text or "").lower()):
        if t:
            v[bucket_of(t, dim)] += 1
    return v


def embed_text(text: str | None, dim: int) -> list[float]:
    """The hashing embedding of one text; a text without [a-z0-9] gives the zero vector."""
    v = hash_counts(text, dim)
    n = math.sqrt(sum(x * x for x in v))
    return [x / n if n else 0.0 for x in v]


class Buckets(dict):
    """Bucket of each token seen by one worker; forgets all when it grows beyond a bound."""

    def __init__(self, dim: int, most: int = 500_000):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        b = self[token] = bucket_of(token, self.dim)
        return b


WORD = re.compile("[a-z0-9]+")


def hashed_cosine(text: Column, query: list) -> Column:
    """Cosine of a text's hashing embedding and a query vector (of counts: then equal texts have equal scores); null for a text without [a-z0-9].

    Arrow batches through a table of known tokens: the same fold as higher-order functions
    inside the JVM took eight times as long, as those are interpreted for every character.
    """
    dim = len(query)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets, q = Buckets(dim), np.asarray(query)
        length = float(np.linalg.norm(q))
        for texts in batches:
            out = np.full(len(texts), np.nan)
            for n, t in enumerate(texts):
                v = _hashed(t, buckets)
                if length and v.any():
                    out[n] = float(v @ q) / (math.sqrt(float(v @ v)) * length)
            yield pd.Series(out, dtype="object").where(~np.isnan(out), None)

    return score(text)


def _hashed(text: str | None, buckets: Buckets) -> np.ndarray:
    """Token counts by bucket."""
    tokens = WORD.findall(text.lower()) if text else ()
    return np.bincount(np.fromiter(map(buckets.__getitem__, tokens), np.int64, len(tokens)), minlength=buckets.dim)


def hashed_buckets(rows: DataFrame, dim: int) -> DataFrame:
    """bucket, seq, n, squares (of all n of the text) for the entries of the hashing embedding of each (seq, text) that are not zero."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Buckets(dim)
        for pdf in batches:
            counts = [_hashed(text, known) for text in pdf["text"]]
            at = [np.flatnonzero(v) for v in counts]
            sizes = [len(x) for x in at]
            flat = np.concatenate([np.empty(0, np.int64), *at])
            n = np.concatenate([np.empty(0, np.int64), *[v[x] for v, x in zip(counts, at)]])
            yield pd.DataFrame({"bucket": flat.astype(np.int32), "seq": np.repeat(pdf["seq"].to_numpy(), sizes), "n": n, "squares": np.repeat([int(v @ v) for v in counts], sizes).astype(np.int64)})

    return rows.filter("seq is not null and text is not null").select("seq", "text").mapInPandas(work, "bucket int, seq long, n long, squares long")


def embed_udf(dim: int):
    """Arrow-batched hashing embedding as array<float>, for storing vectors."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Buckets(dim)
        for s in texts:
            counts = [_hashed(t, known).astype(np.float64) for t in s]
            yield pd.Series([v / (np.sqrt(float(v @ v)) or 1.0) for v in counts], dtype="object")

    return embed


def onnx_embed_udf(model_path: str, tokenizer_path: str, max_tokens: int = 512):
    """Arrow-batched embedding by a staged ONNX model: token vectors averaged under the mask, then scaled to length 1."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(model_path)
        tok = Tokenizer.from_file(tokenizer_path)
        tok.enable_truncation(max_tokens)
        names = {i.name for i in session.get_inputs()}
        for texts in batches:
            out = []
            for t in texts:
                e = tok.encode(t or "")
                feed = {"input_ids": [e.ids], "attention_mask": [e.attention_mask], "token_type_ids": [e.type_ids]}
                hidden = session.run(None, {n: np.asarray(v, np.int64) for n, v in feed.items() if n in names})[0][0]
                out.append(pooled(hidden, np.asarray(e.attention_mask)))
            yield pd.Series(out, dtype="object")

    return embed


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors (tokens, dim) that the mask keeps, of length 1."""
    mean = (hidden * mask[:, None]).sum(axis=0) / max(1.0, float(mask.sum()))
    return mean / (np.linalg.norm(mean) + 1e-12)


def embedder(model_dir: str | None, dim: int):
    """The ONNX embedding where its model and tokenizer are staged in model_dir, else the hashing embedding."""
    files = [os.path.join(model_dir, name) for name in ("model.onnx", "tokenizer.json")] if model_dir else []
    return onnx_embed_udf(*files) if files and all(map(os.path.exists, files)) else embed_udf(dim)

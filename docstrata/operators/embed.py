"""Chunks and embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import RULES
from ..functions.text import chunk_words, words
from ..functions.vectors import mean_pool, normalized


def chunks(content: DataFrame, size: int = RULES.chunk_size, overlap: int = RULES.chunk_overlap) -> DataFrame:
    """artifact_id, project_id, ordinal, text, token_count of content (artifact_id, project_id, raw_text)."""
    rows = content.where("raw_text is not null").select("artifact_id", "project_id", F.posexplode(chunk_words(F.col("raw_text"), size, overlap)).alias("ordinal", "text"))
    return rows.withColumn("token_count", F.size(F.split("text", " ")))


def hash_embedder(dim: int = 64) -> Callable[[pd.Series], list[list[float]]]:
    """Deterministic unit vectors seeded by a hash of the text; a stand-in where no model is given."""

    def embed(texts: pd.Series) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.random.default_rng(int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big")).standard_normal(dim)
            out.append((v / np.linalg.norm(v)).tolist())
        return out

    return embed


def embed_texts(df: DataFrame, text: str = "text", provider: Callable[[], Callable[[pd.Series], list[list[float]]]] = hash_embedder, model: str = "hash", model_version: str | None = None) -> DataFrame:
    """df with vector, model, model_version (the model's name if none is given) and dim; provider() is called
    once per task and then fed batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = provider()
        for batch in batches:
            yield pd.Series(embed(batch))

    made = df.withColumn("vector", run(F.col(text)))
    return made.withColumns({"model": F.lit(model), "model_version": F.lit(model_version or model), "dim": F.size("vector")})


def doc_embeddings(content: DataFrame, chunk_vectors: DataFrame, whole_vectors: DataFrame, most: int = RULES.whole_document_words) -> DataFrame:
    """One vector per artifact with text: its own if it has at most that many words, else the pooled
    vectors of its chunks."""
    sized = content.where(F.size(words(F.col("raw_text"))) > 0).select("artifact_id", "project_id", (F.size(words(F.col("raw_text"))) <= most).alias("short"))
    own = whole_vectors.join(sized.where("short"), "artifact_id").select("artifact_id", "project_id", normalized(F.col("vector")).alias("vector"))
    long = chunk_vectors.select("artifact_id", "vector").join(sized.where("not short"), "artifact_id")
    return own.unionByName(mean_pool(long, ["artifact_id", "project_id"], "vector"))

"""Embeddings: caching, batches, and exact nearest neighbors by cosine."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

QUERY_BLOCK, INDEX_BLOCK = 512, 4096
CACHED = "text string, embedding array<float>"


class Embedder(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic stand-in: directions from a digest of the text."""

    def __init__(self, dims: int = 16) -> None:
        self.dims = dims

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        seeds = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little") for t in texts]
        return [np.random.default_rng(s).standard_normal(self.dims).tolist() for s in seeds]


def embed_missing(texts: DataFrame, cache: DataFrame | None, embedder: Embedder, batch_size: int = 250) -> DataFrame:
    """texts (text) -> cache rows (text, embedding) of those the cache lacks, each once."""
    return _asked(texts, cache, embedder, batch_size).select("text", "embedding")


def _asked(texts: DataFrame, cache: DataFrame | None, embedder: Embedder, batch_size: int) -> DataFrame:
    """embed_missing with a mark on the first text of each call."""
    asked = texts.where("text is not null").select("text").distinct()
    missing = asked.join(cache, "text", "left_anti") if cache is not None else asked

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch_size):
                part = pdf["text"].iloc[i : i + batch_size].tolist()
                yield pd.DataFrame({"text": part, "embedding": [[float(x) for x in v] for v in embedder.embed_batch(part)], "opens": [k == 0 for k in range(len(part))]})

    return missing.mapInPandas(run, "text string, embedding array<float>, opens boolean")


class EmbeddingCache:
    """Embeddings by text in a folder of Parquet files on a store that all machines share; without a
    folder they are kept for the session.  No text is sent twice to a provider."""

    def __init__(self, folder: str = "") -> None:
        self.folder = folder
        self.held: DataFrame | None = None
        self.counts = {"api_calls": 0, "cache_hits": 0}

    def table(self, spark: SparkSession) -> DataFrame | None:
        if not self.folder:
            return self.held
        try:
            return spark.read.option("recursiveFileLookup", True).schema(CACHED).parquet(self.folder)
        except AnalysisException:
            return None

    def embed(self, texts: DataFrame, embedder: Embedder, batch_size: int = 250) -> DataFrame:
        """(text, embedding) of texts (text): what is missing is made, kept and counted."""
        spark = texts.sparkSession
        asked = texts.where("text is not null").select("text").distinct()
        before = self.table(spark)
        if before is not None:
            self.counts["cache_hits"] += asked.join(before, "text", "left_semi").count()
        new = _asked(asked, before, embedder, batch_size)
        if self.folder:
            path = f"{self.folder}/part={uuid.uuid4().hex}"
            new.write.parquet(path)
            self.counts["api_calls"] += spark.read.schema("opens boolean").parquet(path).where("opens").count()
            return self.table(spark).join(asked, "text", "left_semi")
        new = new.persist()
        self.counts["api_calls"] += new.where("opens").count()
        new = new.select("text", "embedding")
        self.held = new if before is None else before.unionByName(new)
        return self.held.join(asked, "text", "left_semi")


def read_json_cache(spark: SparkSession, path: str) -> DataFrame:
    """(text, embedding) of a file with one JSON map from texts to numbers; a missing file is empty."""
    try:
        doc = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return spark.createDataFrame([], CACHED)
    return doc.select(F.explode(F.from_json("value", "map<string, array<float>>")).alias("text", "embedding"))


def _in_blocks(rows: DataFrame, id_col: str, vector_col: str, size: int, name: str) -> DataFrame:
    """Rows of up to `size` ids with their vectors of length one, as bytes of doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), size):
                part = pdf.iloc[i : i + size]
                m = np.array([np.asarray(v, float) for v in part["v"]])
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(norm == 0, 1.0, norm)
                yield pd.DataFrame([(part["id"].to_numpy(np.int64).tobytes(), m.tobytes(), len(part))], columns=[f"{name}_ids", f"{name}_rows", f"{name}_n"])

    chosen = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return chosen.mapInPandas(run, f"{name}_ids binary, {name}_rows binary, {name}_n long")


def nearest(queries: DataFrame, index: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(a_id, b_id, similarity, rank): the k rows of the index nearest each query, ties by b_id.

    Exact.  Blocks of queries meet blocks of the index, each meeting keeps k a query by a matrix
    product, and the best k of those are kept; what is moved is blocks and k rows a meeting, never
    pairs.
    """
    q, x = _in_blocks(queries, id_col, vector_col, QUERY_BLOCK, "q"), _in_blocks(index, id_col, vector_col, INDEX_BLOCK, "x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                a, b = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.x_ids, np.int64)
                s = np.frombuffer(r.q_rows).reshape(r.q_n, -1) @ np.frombuffer(r.x_rows).reshape(r.x_n, -1).T
                n = min(k, len(b))
                # All that are as similar as the n-th or more; where ties make them too many, the least ids of those.
                least = np.partition(s, len(b) - n, axis=1)[:, len(b) - n]
                kept = s >= least[:, None]
                for i in np.flatnonzero(kept.sum(axis=1) > n):
                    at = np.flatnonzero(kept[i])
                    kept[i] = False
                    kept[i, at[np.lexsort((b[at], -s[i, at]))[:n]]] = True
                row, at = np.nonzero(kept)
                yield pd.DataFrame({"a_id": a[row], "b_id": b[at], "similarity": s[row, at]})

    met = q.crossJoin(x).mapInPandas(run, "a_id long, b_id long, similarity double")
    best = Window.partitionBy("a_id").orderBy(F.desc("similarity"), "b_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

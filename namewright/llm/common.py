"""Helpers shared by the corpus operators: table access, shared folders, text rules."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        # A folder of this machine is shared only where all tasks run in the driver.
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        root = "file://" + tempfile.mkdtemp(prefix="namewright-")
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else "file://" + root


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver exits."""
    path = f"{shared_root(spark).rstrip('/')}/namewright-{label}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_sweep)
    _SCRATCH.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _SCRATCH:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is then left
            return


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(label: str) -> str:
    """A column name that no table has."""
    return f"_{label}_{uuid.uuid4().hex}"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(text: object) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None or text is pd.NA or text != text else str(text).encode("utf-8", "surrogatepass")


def hash_words(words: list[bytes] | np.ndarray) -> np.ndarray:
    """Deterministic 64-bit hashes of byte strings."""
    if not len(words):
        return np.zeros(0, np.uint64)
    own = np.empty(len(words), dtype=object)
    own[:] = words
    return pd.util.hash_array(own, categorize=True).astype(np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes; order matters."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix64(out)


def give_back() -> None:
    """Return memory that is free to the system: workers are reused, and what one task needed at its
    peak would otherwise stay with them beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def pieces(pdf: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """Consecutive rows; the texts of a piece but its last have at most `most` characters together."""
    size = pd.Series([0 if t is None or t is pd.NA or t != t else len(t) for t in pdf["text"]], index=pdf.index)
    for _, piece in pdf.groupby((size.cumsum() - size) // most, sort=False):
        yield piece.reset_index(drop=True)


def per_batch(f: Callable[[pd.DataFrame], pd.DataFrame | None], most: int | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """f on each batch, or on pieces of it of about `most` characters in the column text, so that what
    f holds of words does not grow with a batch's texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for piece in [pdf] if most is None or not len(pdf) else pieces(pdf, most):
                out = f(piece)
                if out is not None and len(out):
                    yield out
                    del out
        give_back()

    return run

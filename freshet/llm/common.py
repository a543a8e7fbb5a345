"""Helpers shared by the training-data operators: shared scratch tables, vectorized hashing, components."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Collection

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_WAITING: list[threading.Timer] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a local master (tests) gets a temporary one; a
    cluster's executors wouldn't share it, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN_DIR:
        _OWN_DIR[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-freshet-")
    return _OWN_DIR[context.applicationId]


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder and read it back. All tables of an
    application lie in one folder there, ``freshet-<application id>``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/freshet-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._freshet_path = path
    return out


def release_shuffles(spark: SparkSession, waits: tuple[float, ...] = (0.3, 1.0, 2.0)) -> None:
    """Let Spark's cleaner delete the shuffle files of finished queries soon, not when the driver's memory runs
    short. It runs beside the next query, a few times: the listeners let go of a plan a little after its end."""

    def collect() -> None:
        gc.collect()
        with contextlib.suppress(Exception):  # the session may have stopped meanwhile
            spark._jvm.System.gc()

    for timer in _WAITING:
        timer.cancel()
    _WAITING[:] = [threading.Timer(wait, collect) for wait in waits]
    for timer in _WAITING:
        timer.daemon = True
        timer.start()


def drop_scratch(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read any more."""
    for table in tables:
        path = getattr(table, "_freshet_path", None)
        if path:
            spark = table.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def packed(df: DataFrame) -> Column:
    """A row's columns as one struct ``row``, so that no name among them can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def unpacked(df: DataFrame, skip: Collection[str] = ()) -> list[Column]:
    """The columns of ``row`` again, but for those in ``skip``, which the operator gives anew."""
    return [F.col("row").getField(c).alias(c) for c in df.columns if c not in skip]


# --- vectorized hashing -----------------------------------------------------------------------

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer over an array."""
    x = x.astype(np.uint64, copy=True)
    x += _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def mix_pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of ordered pairs."""
    return mix64(mix64(a ^ np.uint64(salt)) * np.uint64(3) + b)


_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1000))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse modulo 2 ** 64; up to 4 million are kept."""
    if _POWERS and len(_POWERS[0][0]) >= n:
        return _POWERS[0][0][:n], _POWERS[0][1][:n]
    size = max(n, 1 << 17)
    both = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base)])) for base in (_BASE, _INVERSE))
    if size <= 1 << 22:
        _POWERS[:] = [both]
    return both[0][:n], both[1][:n]


def running_sums(values: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Sums of values times powers, from 0 on: the difference of two, times an inverse power, hashes what lies between."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power, out=sums[1:])
    return sums


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of an Arrow string array and its n + 1 offsets from 0; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    arr = texts.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(arr) and arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(arr) else np.zeros(1, np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

    Returns 64-bit hashes, start bytes, end bytes, and for each text the index of its first word
    (n + 1 values). Words never cross texts.
    """
    n_docs = len(offsets) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(n_docs + 1, np.int64)
    is_word = ~_SPACE[data]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    begins = offsets[:-1][(offsets[:-1] < len(data)) & (np.diff(offsets) > 0)]
    first[begins] = is_word[begins]
    starts = np.flatnonzero(first)
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(n_docs + 1, np.int64)
    power, inverse = powers(len(data))
    sums = running_sums(_BYTE[_LOWER][data], power)
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts] ^ mix64((ends - starts).astype(np.uint64)))
    return hashes, starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


# --- connected components ---------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component_id) of every end of ``edges`` (a, b): the smallest id that links reach.

    Alternates large-star and small-star steps; each round is two aggregations, written to the shared
    folder. Ids without an edge are not returned. Rounds needed grow with the logarithm of the
    longest chain.
    """
    cur = write_scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u links to the smallest of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours link to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = write_scratch(small, "cc")
        # a star forest: no id is both an end and a root
        changed = nxt.select("v").distinct().join(nxt.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() or (nxt.groupBy("u").count().where("count > 1").limit(1).count())
        drop_scratch(cur)
        cur = nxt
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = cur.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return pairs.unionByName(roots)


# --- Arrow batches ----------------------------------------------------------------------------


def byte_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1_000_000):
    """Slices of a batch with about ``limit`` bytes of text each (one row at least), so that the
    vectorized work on a batch has bounded memory whatever the texts' lengths."""
    n, i = batch.num_rows, 0
    if not n:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.nan_to_num(np.asarray(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), dtype=float)))
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow lists of ``counts`` consecutive values each."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=kind))

"""Helpers that the training-data operators share: tables, shared storage, byte arrays, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.storage import fresh_path, materialize, shared_dir  # noqa: F401  the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than it must to tell."""
    return df.limit(rows + 1).count() <= rows


BATCH_BYTES = 8 << 20
_BYTES, _UNBOUNDED = "spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 2)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker, which Spark keeps for later tasks, gives unused memory back.

    Texts may be long, so batches are bounded by bytes too, unless the session has a bound of its own.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BYTES, _UNBOUNDED) == _UNBOUNDED:
        spark.conf.set(_BYTES, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    _pow.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc := ctypes.CDLL(None), "malloc_trim"):
        _libc.malloc_trim(0)


# ---------------------------------------------------------------- byte arrays
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def filled(col: pa.Array) -> pa.Array:
    return pc.fill_null(col, "") if col.null_count else col


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows, without copies; null: empty."""
    col = filled(col)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def row_slices(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together; a longer row is a range of its own."""
    _, offs = byte_view(col)
    lo, n = 0, len(col)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_pow: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, for prefix hashes of at least ``n`` bytes."""
    if "p" not in _pow or len(_pow["p"]) < n + 1:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            _pow["p"] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _BASE, np.uint64))])
            _pow["i"] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))])
    return _pow["p"], _pow["i"]


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h such that (h[e] - h[s]) * inverse[s] depends on the bytes s..e only."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * p[: len(data)], out=out[1:])
    return out


# ---------------------------------------------------------------- words and shingles
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = [mix(np.uint64([i + 77]))[0] | np.uint64(1) for i in range(64)]


def word_spans(d: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words (runs of non-space bytes) begin and end, and the first word's index of each row."""
    n = len(d)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ink = ~IS_SPACE[d]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begin = np.empty(n, bool)
    begin[0] = ink[0]
    begin[1:] = ink[1:] & (~ink[:-1] | edge[1:n])
    end = np.empty(n, bool)
    end[-1] = ink[-1]
    end[:-1] = ink[:-1] & (~ink[1:] | edge[1:n])
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def span_hashes(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans s..e, h being the prefix hash."""
    _, inv = powers(len(h))
    return mix((h[e] - h[s]) * inv[s] ^ (e - s).astype(np.uint64))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lowered, and the first word's index of each row."""
    d = LOWER[data]
    s, e, first = word_spans(d, offs)
    return span_hashes(prefix_hash(d), s, e), first


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; a shorter row is one shingle, an empty one none."""
    words, first = word_hashes(data, offs)
    w = len(words)
    with np.errstate(over="ignore"):
        full = np.zeros(max(w - k + 1, 0), np.uint64)
        for j in range(k):
            full += words[j : j + len(full)] * _STEP[j]
        full = mix(full)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                x = np.sort(full[a : b - k + 1])
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                yield x[keep]
            elif b > a:
                h = np.uint64(b - a)
                for j in range(b - a):
                    h = h + words[a + j] * _STEP[j]
                yield mix(np.array([h * _STEP[20 + b - a]], np.uint64))
            else:
                yield full[:0]


# ---------------------------------------------------------------- components
#: So many links are a few MB, and one task finds their components at once; more go through steps over all tasks.
FEW_LINKS = 1 << 18


def _components_of_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b), in one task -> (node, component)."""
    held = [tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")) for batch in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in held)]) for i in range(2))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    # each root with a smaller one beside it is hung below the least of them, then all paths are shortened to one step
    while len(x):
        x, y = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
        x, y = x[x != y], y[x != y]
        np.minimum.at(root, x, y)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])


def components(spark: SparkSession, edges: DataFrame, tag: str) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b); nodes without an edge are absent.

    Alternates large-star and small-star steps: every step is an aggregation and an equi-join, a star of any
    size stays a star, and chains shrink geometrically. FEW_LINKS at most are left to one task.
    """
    if small_enough(edges, FEW_LINKS):
        few = edges.where("a <> b").selectExpr("cast(a AS long) AS a", "cast(b AS long) AS b").coalesce(1)
        return materialize(spark, few.mapInArrow(tidy(_components_of_few), "node long, component long"), tag)
    e = edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct()
    e = materialize(spark, e, tag)
    before = None
    while True:
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v")
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v AS u", "m AS v").where("u <> v")
        e = materialize(spark, small.unionByName(low.selectExpr("u", "m AS v")).distinct(), tag)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

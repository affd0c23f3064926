"""Packing of documents into token sequences along a Hilbert curve.

A document's token ids are hashed into a count vector, projected by fixed random signs to DIMS dimensions, and
placed on a Hilbert curve; documents near each other on the curve are alike. Documents are ordered by curve key, a
hash of their id (so that a group of copies, which share a key, is spread over tasks) and the id. Along that order
their ids form one stream, which is cut every LENGTH ids: all sequences but the very last are full.

Ranges of the order are cut by quantiles of the key; what reaches the driver is one number of tokens for each range.

Defined cases: null or empty text: one piece with the end id alone; repeated rows are packed each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm.common import filled, materialize, mix, row_slices, tidy
from partlens.llm.tokens import TOKENIZER, ids

LENGTH, END_ID = 1024, 0
DIMS, BITS, HASHED = 4, 8, 1024


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of points (n x dims, integers of ``bits`` bits), by bit transposition."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) > 0
            t = (x[0] ^ x[i]) & (q - 1)
            x[0] ^= np.where(high, q - 1, t)
            x[i] ^= np.where(high, 0, t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


_SIGNS = (np.random.default_rng(1879).integers(0, 2, (HASHED, DIMS)) * 2 - 1).astype(np.float64)
_SLOT = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(HASHED)).astype(np.int64)


def _tokenize(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids(name).encode
        for batch in batches:
            texts = filled(batch.column(1))
            for lo, hi in row_slices(texts, 1 << 20):
                flat, starts = encode(texts.slice(lo, hi - lo), END_ID)
                slot = _SLOT[flat]
                points = np.empty((hi - lo, DIMS))
                for i in range(hi - lo):
                    v = np.bincount(slot[starts[i] : starts[i + 1]], minlength=HASHED).astype(np.float64)
                    points[i] = v @ _SIGNS / np.sqrt(v @ v)
                # of unit vectors a projection's spread is 1; two spreads to either side fill the cube
                cell = np.clip((points + 2) / 4 * (1 << BITS), 0, (1 << BITS) - 1)
                doc = batch.column(0).slice(lo, hi - lo)
                spread = mix(doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(36)
                key = hilbert_key(cell) << 28 | spread.astype(np.int64)
                coded = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((starts * 2).astype(np.int32)), pa.py_buffer(flat.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([doc, pa.array(key), pa.array(np.diff(starts), pa.int64()), coded], ["doc_id", "key", "n", "ids"])

    return tidy(run)


def _pieces(base: dict[int, int], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            cols: tuple[list, ...] = tuple([] for _ in range(7))
            for range_no, doc_id, raw in zip(batch.column("range_no").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if range_no != now:
                    now, at = range_no, base[range_no]
                wide = np.frombuffer(raw.as_buffer(), np.uint16).astype("<u4")
                n, start = len(wide), 0
                while start < n:
                    size = min(length - at % length, n - start)
                    for c, x in zip(cols, (doc_id, start, size, zlib.crc32(wide[start : start + size]), n, at // length, at % length), strict=True):
                        c.append(x)
                    start, at = start + size, at + size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tidy(run)


def pack(spark: SparkSession, docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all sequences."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = materialize(spark, src.mapInArrow(_tokenize(tokenizer), "doc_id long, key long, n long, ids binary"), "pack-ids")
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = coded.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.expr("cast(array() AS array<bigint>)")
    ranged = coded.withColumn("range_no", F.size(F.filter(bounds, lambda c: c < F.col("key"))))
    base, total = {}, 0
    for r in ranged.groupBy("range_no").agg(F.sum("n").alias("n")).orderBy("range_no").collect():
        base[r["range_no"]] = total
        total += r["n"]
    dealt = ranged.repartition(n, "range_no").sortWithinPartitions("range_no", "key", "doc_id")
    return dealt.select("range_no", "doc_id", "ids").mapInArrow(_pieces(base, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

"""Token-ID files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Blocks hold BLOCK ids. Three predictions of the next id are mixed: the id last seen after the two before it (order 2), the
one last seen after the one before it (order 1), and the distribution of the frame's ids (order 0), which the frame's header
holds and every block starts from. The weights of the mixture are learned in the block, a set for each context of the two
candidates: whether each was right when last asked, and whether they agree. An id's interval is its candidate's weight,
or order 0's weight times its frequency there; the range coder narrows a window of 48 bits to it and moves words of 16
bits. Every block starts from the same state and carries a CRC-32 of its ids. Blocks are coded side by side, one id of each at
a time, with numpy.

A frame is a row of the file: whole documents in ascending doc_id order, about FRAME ids, as blocks with their
lengths, checksums and the documents' ids and lengths, and the ids before it in its part of the file. Frames are written by
Spark's own writer, so any shared storage will do, and are read and decoded apart from each other.

Defined cases: null or empty text: the end id alone; rows that repeat a doc_id, and those without one (first), are coded each;
a tokenizer with ids of 2**16 and more is refused; an empty table gives an empty file and result; extra columns are ignored;
a damaged block raises ValueError.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm.common import filled, fresh_path, row_slices, tidy
from partlens.llm.tokens import TOKENIZER, ids

BLOCK, FRAME, END_ID = 2048, 4 << 20, 2
#: Contexts of an order share this many slots of a block.
SLOTS = 512
#: A window's bits below the word that moves out, and the bits to which weights and frequencies are mixed.
LOW, MIXED = 32, 24
#: Weights of a candidate, of 2**16, at first; they close in on the least or the most by 2**-_RATE of the distance.
_START, _LEAST, _MOST, _RATE = 6000, 64, 64512, 4
_LANES = (1 << 16) + 1  # both orders' weights in one number
_FRAME = "part int, frame int, before long, doc_ids array<bigint>, doc_lengths array<bigint>, block_lengths array<int>, block_words array<int>, block_crcs array<bigint>, order0 binary, payload binary"


def order0_table(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids that occur and the upper ends of their intervals, of 2**16 together and 1 at least."""
    n = np.bincount(flat, minlength=1)
    found = np.flatnonzero(n)
    if len(found) > 1 << 16:
        raise ValueError("a token file holds ids under 2**16")
    ends = np.cumsum(n[found]) * ((1 << 16) - len(found)) // max(1, len(flat)) + np.arange(1, len(found) + 1)
    return found.astype(np.uint16), ends


def packed_table(order0: tuple[np.ndarray, np.ndarray]) -> bytes:
    steps = [np.diff(x, prepend=0).astype("<u2") for x in (order0[0].astype(np.int64), order0[1] - 1)]
    return zlib.compress(b"".join(x.tobytes() for x in steps), 9)


def unpacked_table(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    found, last = np.cumsum(np.frombuffer(zlib.decompress(raw), "<u2").reshape(2, -1), axis=1, dtype=np.int64)
    return found.astype(np.uint16), last + 1


class _Model:
    """The state of the blocks coded side by side; blocks come with the longest first, so active ones are a prefix."""

    def __init__(self, lanes: int, order0: tuple[np.ndarray, np.ndarray]):
        found, ends = order0
        begins = np.append(0, ends[:-1])
        self.span = np.zeros(1 << 16, np.int64)  # where an id's interval begins and ends
        self.span[found] = begins << 32 | ends
        self.symbol = np.repeat(found, ends - begins).astype(np.int64)
        # a slot holds the last id after a context, twice, and whether it was then expected
        self.two, self.one = np.zeros(lanes * SLOTS, np.uint32), np.zeros(lanes * SLOTS, np.uint32)
        self.base, self.set = np.arange(lanes) * SLOTS, np.arange(lanes) * 8
        self.share = np.full(lanes * 8, _START * _LANES, np.uint32)  # weights of both orders
        self.h1, self.h2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The candidates of both orders and the upper ends of their weights, of 2**16."""
        h = self.h1[:k]
        self.i1 = (h >> 4 & SLOTS - 1) + self.base[:k]
        self.i2 = ((h ^ self.h2[:k]) >> 3 & SLOTS - 1) + self.base[:k]
        two, one = self.two.take(self.i2), self.one.take(self.i1)
        self.c1 = one >> 1
        c2 = two >> 1
        self.at = ((two & 1) << 1 | one & 1 | (self.c1 == c2).astype(np.uint32) << 2) + self.set[:k]
        self.both = self.share.take(self.at)
        s2 = (self.both >> 16).astype(np.int64)
        return c2, self.c1, s2, s2 + (self.both & 0xFFFF)

    def learn(self, k: int, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """hit1: the candidate of order 1 was right and that of order 2 wasn't. Together the weights stay under 2**16."""
        gain = _MOST - _LEAST >> _RATE
        up = hit2 * np.uint32(gain << 16) + hit1 * np.uint32(gain) + np.uint32((_LEAST >> _RATE) * _LANES)
        self.share[self.at] = self.both - (self.both >> _RATE & 0x0FFF * _LANES) + up
        twice = x.astype(np.uint32) << 1
        self.two[self.i2] = twice | hit2
        self.one[self.i1] = twice | (self.c1 == x)
        self.h2[:k] = x * 30011
        self.h1[:k] = x * 40503


def _active(sizes: np.ndarray, step: int) -> int:
    return len(sizes) if sizes[-1] > step else int(np.searchsorted(-sizes, -step, side="left"))


def _interval(span: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, s2: np.ndarray, s21: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ids' intervals begin and end, of 2**MIXED; span: of order 0."""
    fine = MIXED - 16
    two, both, rest = s2 << fine, s21 << fine, (1 << 16) - s21
    begin = both + ((span >> 32) * rest >> 16 - fine)
    end = both + ((span & (1 << 32) - 1) * rest >> 16 - fine)
    begin, end = np.where(hit1, two, begin), np.where(hit1, both, end)
    return begin * ~hit2, np.where(hit2, two, end)


def encode_blocks(blocks: list[np.ndarray], order0: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """The coded bytes of each block of ids (longest block first)."""
    lanes, sizes = len(blocks), np.array([len(b) for b in blocks])
    grid = np.zeros((lanes, sizes[0]), np.uint16)
    for i, b in enumerate(blocks):
        grid[i, : len(b)] = b
    grid = np.ascontiguousarray(grid.T)
    model = _Model(lanes, order0)
    low, wide = np.zeros(lanes, np.int64), np.full(lanes, 1 << LOW + 16)
    room = int(sizes[0]) * 2 + 4
    words = np.zeros(lanes * room, np.uint32)  # a carry stays in a word above 16 bits and moves up at the end
    to = np.arange(lanes) * room
    for step in range(sizes[0]):
        k = _active(sizes, step)
        x = grid[step, :k].astype(np.int64)
        c2, c1, s2, s21 = model.predict(k)
        hit2 = c2 == x
        hit1 = (c1 == x) & ~hit2
        begin, end = _interval(model.span.take(x), hit2, hit1, s2, s21)
        r = wide[:k] >> MIXED
        l = low[:k] + r * begin
        w = r * (end - begin)
        small = w < 1 << LOW
        words[to[:k]] = l >> LOW  # of lanes that move nothing out, to be written over
        to[:k] += small
        l = np.where(small, (l & (1 << LOW) - 1) << 16, l)
        w <<= small * np.int64(16)
        at = np.flatnonzero(w < 1 << LOW)
        while len(at):  # ids so rare that they fill more than a word
            words[to[at]] = l[at] >> LOW
            to[at] += 1
            l[at] = (l[at] & (1 << LOW) - 1) << 16
            w[at] <<= 16
            at = at[w[at] < 1 << LOW]
        low[:k], wide[:k] = l, w
        model.learn(k, x, hit2, hit1)
    out = []
    for i in range(lanes):
        w = np.append(words[i * room : to[i]], np.uint32(int(low[i]) + (1 << LOW) - 1 >> LOW))
        while (w > 0xFFFF).any():
            up = w >> 16
            w &= 0xFFFF
            w[:-1] += up[1:]
        out.append(w.astype("<u2").tobytes())
    return out


def decode_blocks(coded: list[bytes], sizes: list[int], order0: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The ids of each block (longest block first)."""
    lanes, size = len(coded), np.array(sizes)
    n = max(max(len(c) for c in coded) // 2, 2 * sizes[0]) + 4  # a damaged block reads zeros past its end
    words = np.zeros((lanes, n), np.uint16)
    for i, c in enumerate(coded):
        words[i, : len(c) // 2] = np.frombuffer(c, "<u2")
    first = words[:, :3].astype(np.int64)
    code = first[:, 0] << 32 | first[:, 1] << 16 | first[:, 2]
    words = words.ravel()
    used = np.arange(lanes) * n + 3
    grid = np.zeros((size[0], lanes), np.uint16)
    model = _Model(lanes, order0)
    wide = np.full(lanes, 1 << LOW + 16)
    fine = MIXED - 16
    for step in range(size[0]):
        k = _active(size, step)
        c2, c1, s2, s21 = model.predict(k)
        r, c = wide[:k] >> MIXED, code[:k]
        # quotients of whole numbers under 2**53 are exact when floored
        v = np.minimum((c / r).astype(np.int64), (1 << MIXED) - 1)
        hit2 = v < s2 << fine
        hit1 = (v < s21 << fine) & ~hit2
        past = np.maximum(v - (s21 << fine), 0) + 1
        slot = (((past << 16 - fine) - 1) / ((1 << 16) - s21)).astype(np.int64)
        x = np.where(hit2, c2, np.where(hit1, c1, model.symbol.take(slot, mode="clip"))).astype(np.int64)
        begin, stop = _interval(model.span.take(x), hit2, hit1, s2, s21)
        c = c - r * begin
        w = r * (stop - begin)
        small = w < 1 << LOW
        c = np.where(small, c << 16 | words.take(used[:k], mode="clip"), c)
        used[:k] += small
        w <<= small * np.int64(16)
        at = np.flatnonzero(w < 1 << LOW)
        while len(at):
            c[at] = c[at] << 16 | words.take(used[at], mode="clip")
            used[at] += 1
            w[at] <<= 16
            at = at[w[at] < 1 << LOW]
        code[:k], wide[:k] = c, w
        model.learn(k, x, hit2, hit1)
        grid[step, :k] = x
    grid = np.ascontiguousarray(grid.T)
    return [grid[i, :s] for i, s in enumerate(sizes)]


def _write(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), ids(name).encode
        doc_ids: list[int] = []
        lengths, held = [], []
        size = frame = before = 0

        def out() -> pa.RecordBatch:
            flat = np.concatenate(held)
            blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]  # only the last is shorter
            order0 = order0_table(flat)
            coded = encode_blocks(blocks, order0)
            row = {"part": part, "frame": frame, "before": before, "doc_ids": doc_ids, "doc_lengths": np.concatenate(lengths), "block_lengths": [len(b) for b in blocks], "block_words": [len(c) // 2 for c in coded], "block_crcs": [zlib.crc32(b.astype("<u2")) for b in blocks], "order0": packed_table(order0), "payload": b"".join(coded)}
            return pa.RecordBatch.from_pylist([row], schema=_schema())

        for batch in batches:
            texts = filled(batch.column("text"))
            for lo, hi in row_slices(texts, 1 << 20):
                flat, starts = encode(texts.slice(lo, hi - lo), END_ID)
                doc_ids += batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                lengths.append(np.diff(starts))
                held.append(flat)
                size += len(flat)
                if size >= FRAME:
                    yield out()
                    frame, before = frame + 1, before + size
                    doc_ids, lengths, held, size = [], [], [], 0
        if held:
            yield out()

    return tidy(run)


def _schema() -> pa.Schema:
    many = pa.list_
    return pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("before", pa.int64()), ("doc_ids", many(pa.int64())), ("doc_lengths", many(pa.int64())), ("block_lengths", many(pa.int32())), ("block_words", many(pa.int32())), ("block_crcs", many(pa.int64())), ("order0", pa.binary()), ("payload", pa.binary())])


def read_frame(block_lengths: list[int], block_words: list[int], block_crcs: list[int], order0: bytes, payload: bytes) -> np.ndarray:
    """All ids of a frame, checked."""
    ends = np.cumsum(block_words) * 2
    coded = [payload[e - 2 * w : e] for e, w in zip(ends.tolist(), block_words, strict=True)]
    blocks = decode_blocks(coded, block_lengths, unpacked_table(order0))
    for b, crc in zip(blocks, block_crcs, strict=True):
        if zlib.crc32(b.astype("<u2")) != crc:
            raise ValueError("a block of a token file differs from its checksum")
    return np.concatenate(blocks)


def _read(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                flat = read_frame(row["block_lengths"], row["block_words"], row["block_crcs"], row["order0"], row["payload"])
                n = np.array(row["doc_lengths"])
                ends = np.cumsum(n)
                wide = flat.astype("<u4")
                crcs = [zlib.crc32(wide[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n + row["before"] + base[row["part"]]), pa.array(n), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tidy(run)


def write_token_file(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """Encode all documents (doc_id, text) in ascending doc_id order into the file ``path``."""
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = src.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(_write(tokenizer), _FRAME).write.option("compression", "none").parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the decoded file."""
    frames = spark.read.schema(_FRAME).parquet(path)
    # a row for each part that a task wrote; frames and documents never reach the driver
    tokens = F.aggregate("doc_lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = frames.select("part", tokens.alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, total = {}, 0
    for r in sizes:
        base[r["part"]] = total
        total += r["n"]
    return frames.mapInArrow(_read(base), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    path = fresh_path(spark, "token-file")
    write_token_file(spark, docs, path, tokenizer)
    return read_token_file(spark, path)

"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts elsewhere in the table, same document included;
overlaps count, and all strings are judged on the input. Matches never cross documents.

Suffixes are indexed where any string of LENGTH bytes must have one: at its anchors, the places of least hash over
its GRAM-byte grams (ties: all of them), so equal strings have equal anchors. Anchors of a gram found only once
can't repeat and leave. The rest are dealt by gram, each with its context (what may lie in a string around it).
In a task they come in batches. A batch becomes a suffix array of its contexts, with a mirror for what lies before the
anchors; it is merged with the levels of its size, each merged level is scanned for matches of neighbours, and what levels are
left at a gram's end are merged and scanned likewise, so a suffix is merged and scanned about log(n / BATCH) times. Matches are found
by comparing bytes (``Level.scan``).

Anchors move as hashes; equal contexts are aggregated to one with their number before any bytes move: they repeat as
a whole, and a group of any number of copies is one suffix. Contexts are equal if gram and context have equal 64-bit
hashes. A gram with a single context needs no comparison. Contexts of a frequent gram are dealt twice, by the half before the
anchor and by the half after its gram, of which any common string holds one; contexts alone in their half leave.

Defined cases: null or empty text: nothing removed, the digest of no bytes; texts under LENGTH bytes keep all;
copies under different ids are rows like any other; rows that repeat a doc_id, and those without one, are rows of their own, so
a repeated row repeats as a whole; an empty table gives an empty result; extra columns, of any name, are ignored by
``remove_repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm.common import byte_view, materialize, mix, powers, prefix_hash, row_slices, tidy

LENGTH, GRAM = 400, 32
#: Starts of strings that hold an anchor: this many bytes before it at most.
REACH = LENGTH - GRAM
#: A string that holds an anchor holds this many bytes before it or after its gram; grams of more than HOT contexts are dealt by them.
HALF, HOT = REACH // 2, 32
BATCH = 2048


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by blocks (van Herk)."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(h: np.ndarray) -> np.ndarray:
    """Places of grams that are the least of some REACH + 1 neighbours; h: gram hashes of one text."""
    w = REACH + 1
    if len(h) < w:
        return np.zeros(0, np.int64)
    low = _slide_min(h, w)
    # the largest of the minima over the windows that hold a place is its own hash if it is ever the least
    flip = ~np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(~_slide_min(flip, w) == h)


def _grams(data: np.ndarray) -> np.ndarray:
    p = prefix_hash(data)
    n = len(data) - GRAM + 1
    _, inv = powers(len(p))
    return mix((p[GRAM:] - p[:n]) * inv[:n])


def _texts(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        texts = batch.column(col)
        for lo, hi in row_slices(texts):
            data, offs = byte_view(texts.slice(lo, hi - lo))
            for i in range(lo, hi):
                yield batch, i, data[offs[i - lo] : offs[i - lo + 1]]


def _gram_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): the anchors' gram hashes of all texts, counted for about a million at a time."""
    held: list[np.ndarray] = []

    def out():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    total = 0
    for _, _, data in _texts(batches, 0):
        if len(data) >= LENGTH:
            h = _grams(data)
            held.append(h[anchors(h)])
            total += len(held[-1])
            if total > 1 << 20:
                yield out()
                total = 0
    if held:
        yield out()


_OCCURRENCE = "row_id long, row_hash long, pos long, key long, ctx_id long, after int, left_half long, right_half long"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, row_hash, text) -> each anchor with a hash of its context, the number of bytes from it to the context's end, and
    hashes of HALF bytes before it and after its gram, null where there are fewer."""
    held: list[tuple] = []

    def out():
        rows = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) for x in held], axis=0)
        cols = [np.concatenate([x[i] for x in held]) for i in range(1, 9)]
        held.clear()
        halves = [pa.array(cols[i].view(np.int64), mask=~cols[i + 2]) for i in (4, 5)]
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(cols[0]), pa.array(cols[1].view(np.int64)), pa.array(cols[2].view(np.int64)), pa.array(cols[3].astype(np.int32)), *halves], [x.split()[0] for x in _OCCURRENCE.split(", ")])

    total = 0
    for batch, i, data in _texts(batches, 2):
        if len(data) < LENGTH:
            continue
        h = _grams(data)
        at = anchors(h)
        p = prefix_hash(data)
        lo, hi = np.maximum(0, at - REACH), np.minimum(len(data), at + LENGTH)
        whole = (p[hi] - p[lo]) * powers(len(p))[1][lo]
        ctx = mix(mix(whole) + ((at - lo) * 1024 + (hi - at)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        inv, has_left, has_right = powers(len(p))[1], at >= HALF, at + GRAM + HALF <= len(data)
        left, right = np.maximum(at - HALF, 0), np.minimum(at + GRAM, len(data) - 1)
        halves = (p[at] - p[left]) * inv[left], (p[np.minimum(right + HALF, len(data))] - p[right]) * inv[right]
        held.append(((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), at, h[at], ctx, hi - at, mix(halves[0]), mix(halves[1]), has_left, has_right))
        total += len(at)
        if total > 200_000:
            yield out()
            total = 0
    if held:
        yield out()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted: pos, key, group, ctx_id, n) -> (key, group, left, ctx, ctx_id, n)."""
    for batch in batches:
        wanted = batch.column("wanted")
        cols: tuple[list, ...] = ([], [], [], [], [], [])
        size = 0
        for _, i, data in _texts(iter([batch]), 0):
            whole, w = data.tobytes(), wanted[i].values
            for pos, key, group, ctx_id, n in zip(*(w.field(f).to_pylist() for f in ("pos", "key", "group", "ctx_id", "n")), strict=True):
                lo = max(0, pos - REACH)
                for c, x in zip(cols, (key, group, pos - lo, whole[lo : pos + LENGTH], ctx_id, n), strict=True):
                    c.append(x)
                size += 900
            if size > 8 << 20:
                yield _context_batch(cols)
                cols, size = ([], [], [], [], [], []), 0
        if cols[0]:
            yield _context_batch(cols)


def _context_batch(cols: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "group", "left", "ctx", "ctx_id", "n"])


def _common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes rows of x and y share from their begin, ``most`` at most."""
    differ = x != y
    n = differ.argmax(axis=1)
    n[~differ[np.arange(len(n)), n]] = x.shape[1]
    return np.minimum(n, most)


class Contexts:
    """What follows and precedes anchors, the latter backwards, as rows of bytes; room doubles when it is used up.

    ``seen`` has a bit for each number of bytes before the anchor at which a repeated string begins.
    """

    def __init__(self):
        self.size = 0
        self.after, self.before = np.zeros((0, LENGTH), np.uint8), np.zeros((0, REACH), np.uint8)
        self.n_after, self.n_before = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.gram, self.key, self.ctx_id = (np.zeros(0, np.int64) for _ in range(3))
        self.seen = np.zeros((0, (REACH + 8) // 8), np.uint8)

    def add(self, gram: np.ndarray, key: np.ndarray, left: np.ndarray, ctx: pa.Array, ctx_id: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The places of new contexts."""
        data, offs = byte_view(ctx)
        data = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        at, right = offs[:-1] + REACH + left, np.diff(offs) - left
        lo, hi = self.size, self.size + len(key)
        if hi > len(self.key):
            room = max(2 * len(self.key), hi)
            for name in ("after", "before", "n_after", "n_before", "gram", "key", "ctx_id", "seen"):
                old = getattr(self, name)
                new = np.zeros((room, *old.shape[1:]), old.dtype)
                new[:lo] = old[:lo]
                setattr(self, name, new)
        place = slice(lo, hi)
        self.after[place] = sliding_window_view(data, LENGTH)[at]
        self.after[place][np.arange(LENGTH) >= right[:, None]] = 0
        self.before[place] = sliding_window_view(data, REACH)[at - REACH][:, ::-1]
        self.before[place][np.arange(REACH) >= left[:, None]] = 0
        self.n_after[place], self.n_before[place] = np.minimum(right, LENGTH), np.minimum(left, REACH)
        self.gram[place], self.key[place], self.ctx_id[place] = gram, key, ctx_id
        # a context that occurs more than once repeats as a whole
        whole = self._range(self.n_after[place], self.n_before[place]) & (n > 1)[:, None]
        self.seen[place] = np.packbits(whole, axis=1)
        self.size = hi
        return np.arange(lo, hi)

    @staticmethod
    def _range(after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The begins of strings of LENGTH bytes that lie in so many bytes after and before the anchor."""
        d = np.arange(REACH + 1)
        return (d >= (LENGTH - after)[:, None]) & (d <= before[:, None])

    def by_after(self, ids: np.ndarray) -> np.ndarray:
        ids = ids[np.argsort(self.n_after[ids], kind="stable")]
        ids = ids[np.argsort(self.after[ids].view(f"S{LENGTH}").ravel(), kind="stable")]
        return ids[np.argsort(self.key[ids], kind="stable")]

    def by_before(self, ids: np.ndarray) -> np.ndarray:
        ids = ids[np.argsort(self.n_before[ids], kind="stable")]
        ids = ids[np.argsort(self.before[ids].view(f"S{REACH}").ravel(), kind="stable")]
        return ids[np.argsort(self.key[ids], kind="stable")]


class Level:
    """A suffix array of contexts and its mirror: within a group by what follows the anchors, and by what lies before."""

    def __init__(self, all_: Contexts, after: np.ndarray, before: np.ndarray):
        self.all, self.after, self.before = all_, after, before

    @classmethod
    def of(cls, all_: Contexts, ids: np.ndarray) -> Level:
        return cls(all_, all_.by_after(ids), all_.by_before(ids))

    def merged(self, other: Level) -> Level:
        # two sorted runs each: the stable sorts merge them
        return Level(self.all, self.all.by_after(np.concatenate([self.after, other.after])), self.all.by_before(np.concatenate([self.before, other.before])))

    def scan(self) -> None:
        """Find the strings that repeat in this level, by the neighbours of each context in both orders.

        A context shares the most bytes after the anchor with its neighbours in the suffix array, and ever less with
        those farther away; likewise before it in the mirror. A pair that shares x bytes after and y before the
        anchor has in common the strings that begin LENGTH - x to y bytes before it. Contexts that were met in neither order up
        to a distance share at most what those at that distance do; when all strings that this allows are found, a context is done.
        """
        c, n = self.all, len(self.after)
        place_a, place_b = np.zeros(c.size, np.int64), np.zeros(c.size, np.int64)
        place_a[self.after], place_b[self.before] = np.arange(n), np.arange(n)
        for lo in range(0, n, CHUNK):
            active = self.after[lo : lo + CHUNK]
            step = 0
            while len(active):
                step += 1
                found = np.unpackbits(c.seen[active], axis=1, count=REACH + 1).astype(bool)
                bound_a, bound_b = np.zeros(len(active), np.int32), np.zeros(len(active), np.int32)
                for order, place, bound, is_after in ((self.after, place_a, bound_a, True), (self.before, place_b, bound_b, False)):
                    for side in (-step, step):
                        q = place[active] + side
                        ok = (q >= 0) & (q < n)
                        ok[ok] = c.key[order[q[ok]]] == c.key[active[ok]]
                        at = np.flatnonzero(ok)
                        if not len(at):
                            continue
                        i, j = active[at], order[q[at]]
                        x = _common(c.after[i], c.after[j], np.minimum(c.n_after[i], c.n_after[j]))
                        y = _common(c.before[i], c.before[j], np.minimum(c.n_before[i], c.n_before[j]))
                        bound[at] = np.maximum(bound[at], x if is_after else y)
                        x[x < GRAM] = 0  # another gram of the same hash
                        found[at] |= c._range(x, y)
                c.seen[active] = np.packbits(found, axis=1)
                more = (c._range(bound_a, bound_b) & ~found).any(axis=1)
                active = active[more]


#: Contexts that are scanned together.
CHUNK = 1024


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, group, left, ctx, ctx_id, n), all of a group in one task and in order: (key, ctx_id, lo, hi), the ranges of bytes
    before the anchor at which repeated strings begin. Groups come in order, so a finished one's suffixes leave the index."""
    all_, levels = Contexts(), []

    def absorb(ids: np.ndarray) -> None:
        """A batch becomes a level; levels of its size are merged with it and scanned against it."""
        level = Level.of(all_, ids)
        level.scan()
        while levels and len(levels[-1].after) <= len(level.after):
            level = levels.pop().merged(level)
            level.scan()
        levels.append(level)

    def flush() -> pa.RecordBatch:
        """The index's levels, smallest first, are merged with one another and scanned; it is empty after that."""
        nonlocal all_
        while len(levels) > 1:
            small = levels.pop()
            levels.append(levels.pop().merged(small))
            levels[-1].scan()
        levels.clear()
        flags = np.unpackbits(all_.seen[: all_.size], axis=1, count=REACH + 1)
        edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, lo = np.nonzero(edge == 1)
        hi = np.nonzero(edge == -1)[1] - 1
        out = pa.RecordBatch.from_arrays([pa.array(all_.gram[who]), pa.array(all_.ctx_id[who]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["key", "ctx_id", "lo", "hi"])
        all_ = Contexts()
        return out

    last = None
    for batch in batches:
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "group", "left", "ctx_id", "n")}
        keys = cols["group"]
        ends = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys)) if len(keys) else []
        lo = 0
        while lo < len(keys):
            if last is not None and keys[lo] != last and all_.size >= BATCH:
                yield flush()
            # whole groups, about a batch of them; of a group of more than that a part
            hi = int(ends[max(np.searchsorted(ends, lo + BATCH, side="right") - 1, 0)])
            hi = hi if hi > lo else min(lo + BATCH, len(keys))
            part = slice(lo, hi)
            absorb(all_.add(cols["key"][part], keys[part], cols["left"][part], batch.column("ctx").slice(lo, hi - lo), cols["ctx_id"][part], cols["n"][part]))
            last, lo = keys[hi - 1], hi
    if all_.size:
        yield flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> what is left of each text; spans: repeated ranges, in any order."""
    for batch in batches:
        spans, ids = batch.column("spans"), batch.column("doc_id")
        first, size = 0, 0
        cols: tuple[list, ...] = ([], [], [], [], [])

        def out(lo: int, hi: int):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

        for j, (_, i, data) in enumerate(_texts(iter([batch]), 1)):
            assert i == j
            n, left, runs = len(data), data.tobytes(), 0
            own = spans[i].values if spans[i].is_valid else None
            if own is not None and len(own):
                step = np.zeros(n + 1, np.int32)
                np.add.at(step, own.field(0).to_numpy(zero_copy_only=False), 1)
                np.add.at(step, own.field(1).to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(step[:n]) > 0
                left, runs = data[~gone].tobytes(), len(_runs(gone))
            # a cut may part the bytes of a character; such bytes count in the digest and are no text
            for c, x in zip(cols, (n, n - len(left), runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")), strict=True):
                c.append(x)
            size += n
            if size > 4 << 20:
                yield out(first, i + 1)
                first, size, cols = i + 1, 0, ([], [], [], [], [])
        if cols[0]:
            yield out(first, batch.num_rows)


def _rows(docs: DataFrame) -> DataFrame:
    """docs with row_id and row_hash, which name a row's id and text together: rows that repeat an id keep apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("row_id"), F.xxhash64(text, F.isnull("doc_id")).alias("row_hash"))


def _spans(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(row_id, row_hash, spans) of the rows (row_id, row_hash, text) that hold repeats."""
    keys = rows.select("text").mapInArrow(tidy(_gram_keys), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    keys = materialize(spark, keys, "suffix-keys")  # written, so that the join can be split where one gram is frequent
    found = rows.select("row_id", "row_hash", "text").mapInArrow(tidy(_occurrences), _OCCURRENCE).join(keys, "key", "left_semi")
    found = materialize(spark, found, "suffix-anchors")
    # equal contexts are one; a gram with one context only repeats with it as a whole, and nothing is to be compared
    halves = [F.first(c).alias(c) for c in ("left_half", "right_half")]
    one = found.groupBy("key", "ctx_id").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "row_hash", "pos")).alias("at"), F.first("after").alias("after"), *halves)
    one = materialize(spark, one, "suffix-contexts")
    several = materialize(spark, one.groupBy("key").agg(F.count("*").alias("d")), "suffix-grams")  # likewise
    told = one.join(several, "key")
    left = F.least("at.pos", F.lit(REACH)).cast("int")
    alone = told.where("n > 1").select("key", "ctx_id", F.greatest(F.lit(0), LENGTH - F.col("after")).alias("lo"), left.alias("hi")).where("lo <= hi")
    # of a frequent gram those contexts meet that share the half which a common string must hold: a line that is frequent but short
    # brings no contexts together
    cold = told.where(f"d BETWEEN 2 AND {HOT}").withColumn("group", F.col("key"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("left_half").alias("h")), F.struct(F.lit(1).alias("side"), F.col("right_half").alias("h")))
    split = materialize(spark, told.where(f"d > {HOT}").withColumn("x", F.explode(sides)).where("x.h IS NOT NULL").withColumn("group", F.xxhash64("key", "x.side", "x.h")).drop("x"), "suffix-halves")
    shared = materialize(spark, split.groupBy("group").agg(F.count("*").alias("c")).where("c > 1").select("group"), "suffix-groups")
    met = cold.unionByName(split.join(shared, "group", "left_semi"))
    asked = met.groupBy("at.row_id", "at.row_hash").agg(F.collect_list(F.struct(F.col("at.pos").alias("pos"), "key", "group", "ctx_id", "n")).alias("wanted"))
    # rows that repeat id and text are one here: ``n`` counts their contexts
    contexts = rows.join(asked, ["row_id", "row_hash"]).select("text", "wanted").mapInArrow(tidy(_contexts), "key long, group long, left int, ctx binary, ctx_id long, n long")
    hits = contexts.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(_index), "key long, ctx_id long, lo int, hi int")
    hits = materialize(spark, hits.unionByName(alone), "suffix-hits")
    spans = found.select("row_id", "row_hash", "pos", "key", "ctx_id").join(hits, ["key", "ctx_id"]).selectExpr("row_id", "row_hash", f"struct(pos - hi AS a, pos - lo + {LENGTH} AS b) AS span")
    return spans.groupBy("row_id", "row_hash").agg(F.collect_set("span").alias("spans"))


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept holds the bytes left, as text."""
    rows = _rows(docs)
    spans = _spans(spark, rows.where(F.octet_length("text") >= LENGTH))
    return rows.join(spans, ["row_id", "row_hash"], "left").select("doc_id", "text", "spans").mapInArrow(tidy(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def without_repeats(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes cut from the text; documents of which nothing is left leave."""
    names = docs.columns
    one, two, had = (f"{x}_{'_'.join(names)}" for x in ("id", "hash", "spans"))  # names that docs can't have
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({one: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), two: F.xxhash64(text, F.isnull("doc_id"))})
    spans = _spans(spark, keyed.select(F.col(one).alias("row_id"), F.col(two).alias("row_hash"), text.alias("text")).where(F.octet_length("text") >= LENGTH))
    both = keyed.join(spans.select(F.col("row_id").alias(one), F.col("row_hash").alias(two), F.col("spans").alias(had)), [one, two], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, done = batch.schema.names, 0
            asked = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at.index(text_col)).cast(pa.string()), batch.column(at.index(had))], ["doc_id", "text", "spans"])
            for got in _cut(iter([asked])):
                part, done = batch.slice(done, got.num_rows), done + got.num_rows
                cols = {c: part.column(c) for c in names}
                removed, left = got.column("n_removed").to_numpy(), got.column("kept")
                cols[text_col] = pc.if_else(pa.array(removed > 0), left, cols[text_col].cast(pa.string()))
                if "n_chars" in cols:
                    cols["n_chars"] = pc.if_else(pa.array(removed > 0), pc.utf8_length(left).cast(cols["n_chars"].type), cols["n_chars"])
                keep = (removed == 0) | (removed < got.column("n_bytes").to_numpy())
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names).filter(pa.array(keep))

    kinds = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema.fields)
    return both.select(*names, had).mapInArrow(tidy(cut), kinds)

"""Near-duplicate embeddings by a subspace pigeonhole join over tiles of vectors.

Vectors are scaled to length 1 and turned by a fixed random rotation; cosine >= COSINE is then a squared distance of at
most 2 - 2 * COSINE. The dimensions are split into two subspaces, among which that budget is dealt (pigeonhole with unequal
shares): the first, of ``lead`` dimensions, gets all of it, the rest nothing, so that pairs are held against the first alone. All pairs
have to be told apart there, as at 64 dimensions the radius is beyond what cells, boxes or pivots can bound: eight blocks with an eighth of the
budget each take eight products of all pairs and leave 80 times as many pairs as one of 24 dimensions does. What passes is compared exactly, in
double precision and by the vectors as given; where much passes, a product over all dimensions comes between.

Equal vectors are one class with a weight, so a group of copies costs one vector. Classes are written once, packed into tiles; tasks
read them in pairs of partitions of that table, and each pair of tiles meets in one task. A task returns sums of links for each vector
and a spanning forest of its links, never the pairs, and components come from the forests. So what is written is in proportion to the input (where
a task's vectors have links, a sum and a forest link for each more), and the comparisons grow as the square of the classes.

Defined cases: vectors that are null, empty, zero, or hold nulls or non-finite values: no links, own component, kept; vectors
of each length are joined by themselves, of different lengths never; rows that repeat a vec_id are rows of their own, each with the
links of its vector; a vector without an id is a component's id nowhere; empty tables give empty results; extra columns are ignored.
Rows find their class again by 128 bits of its vector's SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from partlens.llm.common import components, materialize, tidy

COSINE = 0.9
#: A tile holds this many vectors and bytes at most, a partition of the table of tiles about so many full tiles.
TILE, TILE_BYTES, TILES = 4096, 4 << 20, 8
#: Slack for rounding in bounds; what passes them is compared exactly.
SLACK = 1e-5
#: Cosines in single precision that are this near to the limit are computed again in double precision.
CLOSE = 4e-6
#: Rows of a tile that are held against another tile at once, and the share of pairs from which on all dimensions are multiplied.
ROWS, DENSE = 128, 1 / 64
#: Bytes of unit vectors, in double precision, that a task keeps prepared.
KEPT = 32 << 20


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(4711).standard_normal((dim, dim)))[0]


def lead(dim: int, budget: float) -> int:
    """So many dimensions, by eights, that few of independent vectors are within ``budget`` in them (about 2 in 10,000 by Wilson and Hilferty)."""
    for k in range(8, dim, 8):
        if ((budget * dim / 2 / k) ** (1 / 3) - 1 + 2 / (9 * k)) / (2 / (9 * k)) ** 0.5 <= -3.5:
            return k
    return dim


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, v) -> v as bytes."""
    for batch in batches:
        v = batch.column(1)
        width = v.type.value_type.bit_width // 8
        ends = np.cumsum(pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)) * width
        flat = v.flatten().to_numpy(zero_copy_only=False)
        valid = np.packbits(v.is_valid().to_numpy(zero_copy_only=False), bitorder="little")
        offs = np.concatenate([np.zeros(1, np.int32), ends.astype(np.int32)])
        packed = pa.Array.from_buffers(pa.binary(), len(v), [pa.py_buffer(valid.tobytes()), pa.py_buffer(offs.tobytes()), pa.py_buffer(flat.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["vec_id", "vec"])


_TILE = "d int, tile long, vecs binary, weights array<long>, firsts array<long>, keys array<binary>"


def _tiles(width: int, most: int, most_bytes: int):
    """(vec, key, first, weight) -> tiles of vectors of one length; the class at place i of a tile has the number tile + i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        number = TaskContext.get().partitionId() << 40

        def out(d: int, rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal number
            n = rows.num_rows
            ends = pa.array([0, n], pa.int32())
            vecs = b"".join(rows.column("vec").to_pylist())
            lists = [pa.ListArray.from_arrays(ends, rows.column(c)) for c in ("weight", "first", "key")]
            number += n
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([number - n]), pa.array([vecs], pa.binary()), *lists], [x.split()[0] for x in _TILE.split(", ")])

        for batch in batches:
            sizes = pc.binary_length(batch.column("vec")).to_numpy() // width
            for d in np.unique(sizes).tolist():
                full = max(1, min(most, most_bytes // (d * width)))
                parts = held.setdefault(d, [])
                parts.append(batch if (sizes == d).all() else batch.filter(pa.array(sizes == d)))
                if sum(x.num_rows for x in parts) >= full:
                    rows = pa.concat_batches(parts)
                    for lo in range(0, rows.num_rows - full + 1, full):
                        yield out(d, rows.slice(lo, full))
                    rest = rows.num_rows % full
                    # what stays is copied, so that the batches it came with can leave
                    held[d] = [rows.take(pa.array(np.arange(rows.num_rows - rest, rows.num_rows)))] if rest else []
        for d, parts in held.items():
            if parts:
                yield out(d, pa.concat_batches(parts))

    return run


class Side:
    """A tile's unit vectors, and for each what makes a product of two minus half their squared distance in the leading subspace."""

    def __init__(self, vecs: bytes, weight: np.ndarray, kind: np.dtype, turn: np.ndarray):
        self.unit = _unit(np.frombuffer(vecs, kind).reshape(-1, len(turn)).astype(np.float64))
        self.single = self.unit.astype(np.float32)
        self.weight = weight
        z = (self.unit @ turn).astype(np.float32)
        half = (z.astype(np.float64) ** 2).sum(axis=1, keepdims=True) / 2
        ones = np.ones_like(half)
        self.mine, self.yours = (np.concatenate(x, axis=1).astype(np.float32) for x in ([z, -half, ones], [z, ones, -half]))


def _places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask with few places set, by words of eight."""
    words = len(mask) // 8
    hit = np.flatnonzero(mask[: 8 * words].view(np.uint64))
    w, b = np.nonzero(mask[: 8 * words].reshape(-1, 8)[hit])
    return np.concatenate([hit[w] * 8 + b, 8 * words + np.flatnonzero(mask[8 * words :])])


def near_pairs(x: Side, y: Side, same: bool, cosine: float, dense: float = DENSE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in x, in y) of all pairs with at least this cosine, each once; ``same``: y is x."""
    budget = 2 - 2 * cosine
    limit, n = np.float32(-(budget * (1 + SLACK) + SLACK) / 2 - 2e-6), len(y.unit)
    for lo in range(0, len(x.unit), ROWS):
        rows = slice(lo, lo + ROWS)
        # a pair of a tile with itself is met from its smaller place
        first = lo if same else 0
        at = _places((x.mine[rows] @ y.yours[first:].T).ravel() >= limit)
        if len(at) > dense * len(x.mine[rows]) * (n - first):
            at = _places((x.single[rows] @ y.single[first:].T).ravel() >= np.float32(cosine - CLOSE))
        i, j = np.divmod(at, n - first)
        i, j = i + lo, j + first
        if same:
            i, j = i[i < j], j[i < j]
        for t in range(0, len(i), 1 << 15):
            a, b = i[t : t + (1 << 15)], j[t : t + (1 << 15)]
            ok = (x.unit[a] * y.unit[b]).sum(axis=1) >= cosine
            if ok.any():
                yield a[ok], b[ok]


class Links:
    """Sums of links and a forest of them, for the tiles that a task meets."""

    def __init__(self):
        self.base: dict[int, int] = {}
        self.rep, self.n, self.root = (np.zeros(0, np.int64) for _ in range(3))

    def place(self, tile: int, size: int) -> int:
        if tile not in self.base:
            self.base[tile] = at = len(self.rep)
            self.rep = np.concatenate([self.rep, np.arange(tile, tile + size)])
            self.n = np.concatenate([self.n, np.zeros(size, np.int64)])
            self.root = np.concatenate([self.root, np.arange(at, at + size)])
        return self.base[tile]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
            a, b = a[a != b], b[a != b]
            np.minimum.at(root, a, b)
            while (root[root] != root).any():
                root[:] = root[root]

    def meet(self, p: int, x: Side, q: int, y: Side, cosine: float) -> None:
        at_x, at_y = self.place(p, len(x.unit)), self.place(q, len(y.unit))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in near_pairs(x, y, p == q, cosine):
            for at, k, w in ((at_x, i, y.weight[j]), (at_y, j, x.weight[i])):
                np.add.at(self.n, at + k, w)
            a, b = at_x + i, at_y + j
            new = self.root[a] != self.root[b]
            held.append((a[new], b[new]))
            if sum(len(h[0]) for h in held) > 1 << 18:
                self.join(*(np.concatenate(h) for h in zip(*held, strict=True)))
                held.clear()
        if held:
            self.join(*(np.concatenate(h) for h in zip(*held, strict=True)))

    def rows(self) -> pa.RecordBatch:
        """kind 0: sums of links (a, x); 1: forest links (a, x)."""
        got, hung = np.flatnonzero(self.n), np.flatnonzero(self.root != np.arange(len(self.root)))
        a, x = np.concatenate([self.rep[got], self.rep[hung]]), np.concatenate([self.n[got], self.rep[self.root[hung]]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.repeat(np.arange(2, dtype=np.int32), [len(got), len(hung)])), pa.array(x)], ["a", "kind", "x"])


def _meet(dim: int, cosine: float, kind: np.dtype):
    """Pairs of tiles (p, q with vectors and weights) -> sums and forest links of all of a task's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)[:, : lead(dim, 2 - 2 * cosine)]
        links, sides = Links(), {}
        for batch in batches:
            for r in range(batch.num_rows):
                p, q = (batch.column(c)[r].as_py() for c in ("p", "q"))
                for side, tile in (("p", p), ("q", q)):
                    # the last to be asked for stay: a tile meets many others
                    here = sides.pop(tile, None)
                    if here is None:
                        weight = batch.column(f"{side}_weights")[r].values.to_numpy().copy()
                        here = Side(batch.column(f"{side}_vecs")[r].as_py(), weight, kind, turn)
                    sides[tile] = here
                x, y = sides[p], sides[q]
                while len(sides) > 2 and sum(s.unit.nbytes for s in sides.values()) > KEPT:
                    del sides[next(iter(sides))]
                links.meet(p, x, q, y, cosine)
        if len(links.rep):
            yield links.rows()

    return run


def _linked(spark: SparkSession, tiles: DataFrame, dim: int, cosine: float, kind: np.dtype) -> DataFrame:
    """(rep, n, component) of classes in tiles of vectors of dim components; classes without links may be absent."""
    one, two = (tiles.select(F.col("tile").alias(s), F.col("vecs").alias(f"{s}_vecs"), F.col("weights").alias(f"{s}_weights")) for s in ("p", "q"))
    # no tile is moved: a task reads two partitions; of (p, q) and (q, p) one is met, so that half of either's pairs are in each
    met = one.crossJoin(two).where("p = q OR (p < q) = ((xxhash64(p) ^ xxhash64(q)) & 1 = 0)")
    found = materialize(spark, met.mapInArrow(tidy(_meet(dim, cosine, kind)), "a long, kind int, x long"), "emb-links")
    sums = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("x").alias("n"))
    groups = components(spark, found.where("kind = 1").selectExpr("a", "x AS b"), "emb-cc").withColumnRenamed("node", "rep")
    return sums.join(groups, "rep", "left")


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    given = vectors.schema[vec_col].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    kind = np.dtype(np.float32 if single else np.float64)
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v"))
    good = F.expr("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    rows = src.select("vec_id", F.when(good, F.col("v")).alias("v")).mapInArrow(tidy(_pack), "vec_id long, vec binary")
    key = F.expr("unhex(substring(sha2(vec, 256), 1, 32))").alias("key")
    # equal vectors are a class; its number, unlike an id, is no other class's
    classes = rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")).select("vec", key, "first", "weight")
    parts = max(spark.sparkContext.defaultParallelism, -(-vectors.count() // (TILE * TILES)))
    tiles = materialize(spark, classes.coalesce(parts).mapInArrow(tidy(_tiles(kind.itemsize, TILE, TILE_BYTES)), _TILE), "emb-tiles")
    linked = None
    # vectors of each length are joined by themselves; a row for each length reaches the driver
    for r in tiles.groupBy("d").agg(F.sum(F.size("firsts")).alias("n")).where("n > 1").orderBy("d").collect():
        one = _linked(spark, tiles.where(F.col("d") == r["d"]), r["d"], cosine, kind)
        linked = one if linked is None else linked.unionByName(one)
    told = tiles.select("tile", F.posexplode(F.arrays_zip("firsts", "weights", "keys")).alias("i", "c"))
    told = told.selectExpr("tile + i AS rep", "c.firsts AS first", "c.weights AS weight", "c.keys AS key")
    none = F.lit(None).cast("long")
    told = told.withColumns({"n": none, "component": none}) if linked is None else told.join(linked, "rep", "left")
    told = told.withColumn("component", F.coalesce("component", "rep"))
    least = told.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = told.join(least, "component").select("key", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", key).join(by_class, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact shingle similarity.

Native: DataFrame and SQL functions only. Words are lower-cased runs of non-space characters; shingles take five
words, or all words of a shorter item. For an item of n words a document's windows are its runs of n words, cut at the document's
ends. A window of the similarity asked for shares three quarters of an item's shingles, so only starts at which so many of
the window's shingles occur in items of that length are looked at: all others fall short, none is left out by chance.
Each such window gets a 64-bit SimHash of its shingles. The bits are split into RADIUS + 1 blocks; a window and an item of its
length that agree in a block are candidates, which finds every pair of fingerprints within RADIUS bits. Candidates within
RADIUS are verified on whole shingle multisets: weight of the intersection over weight of the union, the weight of a shingle
being its number of occurrences, at ``least`` or more. At a similarity of 0.75 fingerprints differ in 11 bits of 64 on average, with a
deviation of 3; RADIUS is 4.3 deviations above that, so blocks are two or three bits wide, and it is the windows' starts and the
exact similarity that decide most.

Broadcast is the benchmark's shingle table, and only if it has at most BROADCAST_ROWS rows; else it is shuffled.

Defined cases: null or empty texts on either side match nothing; documents without an id can't be named and are left alone; of several windows of a document and item the most
similar counts, ties to the first; repeated items report each item_id; repeated rows of a doc_id count as one
document whose windows are all judged; texts of any length are read whole, a window's work grows with its own length; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm.common import materialize, small_enough

K, RADIUS, LEAST = 5, 24, 0.75
BROADCAST_ROWS = 500_000
#: The first bit and the width of each block; together they are the 64 bits.
BLOCKS = [(64 * i // (RADIUS + 1), 64 * (i + 1) // (RADIUS + 1) - 64 * i // (RADIUS + 1)) for i in range(RADIUS + 1)]


def let(value: str, name: str, body: str) -> str:
    """SQL that computes value once and uses it under a name; a plain column would be computed at each use."""
    return f"transform(array({value}), {name} -> {body})[0]"


def words(text: str) -> str:
    """SQL for the words of a text; none for null."""
    return f"filter(split(coalesce(lower({text}), ''), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')"


def shingles(text: str, k: int) -> Column:
    """Hashes of the text's k-word shingles in order."""
    args = ", ".join(f"w[i + {j}]" for j in range(k))
    return F.expr(let(words(text), "w", f"CASE WHEN size(w) >= {k} THEN transform(sequence(0, size(w) - {k}), i -> xxhash64({args})) ELSE cast(array() AS array<bigint>) END"))


#: Up to so many hashes their bits are counted side by side, in eight bytes of eight numbers.
LANES = 255


def simhash(h: str) -> Column:
    """The majority of each bit over the hashes of an array."""
    mask = "72340172838076673L"  # the lowest bit of each byte
    added = ", ".join(f"a[{i}] + (shiftrightunsigned(x, {i}) & {mask})" for i in range(8))
    few = let(f"aggregate(hs, array({', '.join(['0L'] * 8)}), (a, x) -> array({added}))", "n", "aggregate(sequence(0, 63), 0L, (acc, b) -> acc | CASE WHEN 2 * (shiftrightunsigned(n[b % 8], b - b % 8) & 255L) > size(hs) THEN shiftleft(1L, b) ELSE 0L END)")
    ones = "aggregate(hs, 0, (n, x) -> n + cast(shiftrightunsigned(x, b) & 1L AS int))"
    many = f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | CASE WHEN 2 * {ones} > size(hs) THEN shiftleft(1L, b) ELSE 0L END)"
    return F.expr(let(h, "hs", f"CASE WHEN size(hs) <= {LANES} THEN {few} ELSE {many} END"))


def blocks(fingerprint: str) -> Column:
    """An array of (block number, block value)."""
    parts = ", ".join(f"struct({i} AS no, shiftrightunsigned({fingerprint}, {b}) & {(1 << w) - 1}L AS value)" for i, (b, w) in enumerate(BLOCKS))
    return F.expr(f"array({parts})")


def as_set(h: str) -> Column:
    """A multiset as a set: each hash with the number of its earlier occurrences."""
    ranked = let(f"array_sort({h})", "s", "transform(s, (x, i) -> xxhash64(x, i + 1 - array_position(s, x)))")
    return F.expr(f"CASE WHEN size(array_distinct({h})) = size({h}) THEN transform({h}, x -> xxhash64(x, 0L)) ELSE {ranked} END")


def starts(at: str, k: int, least: float) -> Column:
    """Starts of windows that hold ceil(least * N) of the places ``at``, N being the number of an item's shingles, n - k + 1."""
    need = f"cast(ceil({least} * (n - {k - 1})) AS int)"
    first = f"at[j + {need} - 1] - (n - {k - 1}) + 1"  # earlier starts don't reach the last of so many places
    ranges = f"transform(sequence(0, size(at) - {need}), j -> struct(CASE WHEN j > 0 THEN greatest(at[j - 1] + 1, {first}) ELSE {first} END AS lo, at[j] AS hi))"
    return F.expr(f"CASE WHEN size(at) >= {need} THEN flatten(transform(filter({ranges}, r -> r.lo <= r.hi), r -> sequence(r.lo, r.hi))) ELSE cast(array() AS array<int>) END".replace("at[", f"{at}[").replace("size(at)", f"size({at})"))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, start_word, similarity, hamming): documents that hold an item, with the best window."""
    items = benchmark.select("item_id", "text", F.size(F.expr(words("text"))).alias("n")).where("n > 0")
    found = None
    lengths = [r[0] for r in items.select(F.least("n", F.lit(K)).alias("k")).distinct().orderBy("k").collect()]
    for k in lengths or [K]:
        own = items.where(F.least("n", F.lit(K)) == k).select("item_id", "n", shingles("text", k).alias("h"))
        # written, as are the windows: what is costly is then computed once, not once for each use of a column
        own = materialize(spark, own.withColumns({"ifp": simhash("h"), "ih": as_set("h")}), "decon-items")
        places = own.select("n", F.explode("h").alias("sh")).distinct()
        if small_enough(places, BROADCAST_ROWS):
            places = F.broadcast(places)
        held = docs.select("doc_id", F.posexplode(shingles("text", k)).alias("p", "sh")).join(places, "sh")
        dense = held.groupBy("doc_id", "n").agg(F.sort_array(F.collect_set("p")).alias("at")).withColumn("s", starts("at", k, least)).where("size(s) > 0")
        asked = dense.groupBy("doc_id").agg(F.collect_list(F.struct("n", "s")).alias("at"))
        windows = docs.select("doc_id", "text").join(asked, "doc_id").select("doc_id", shingles("text", k).alias("h"), F.explode("at").alias("a")).select("doc_id", "h", F.col("a.n").alias("n"), F.explode("a.s").alias("s"))
        windows = windows.select("doc_id", "n", "s", F.expr(f"slice(h, greatest(s, 0) + 1, greatest(s + n - {k - 1} - greatest(s, 0), 0))").alias("hw"))
        # a window under ``least`` of the item's length can't reach that similarity
        windows = materialize(spark, windows.where(f"size(hw) >= {least} * (n - {k - 1})"), "decon-windows")
        windows = materialize(spark, windows.withColumn("fp", simhash("hw")), "decon-fingerprints")
        # of the blocks that a pair shares the first one reports it
        near = windows.select("doc_id", "n", "s", "fp", F.explode(blocks("fp")).alias("b")).join(own.select("item_id", "n", "ifp", F.explode(blocks("ifp")).alias("b")), ["n", "b"])
        near = near.withColumn("hamming", F.expr("bit_count(fp ^ ifp)")).where(F.col("hamming") <= RADIUS)
        near = near.where(F.expr("filter(" + blocks_equal("fp", "ifp") + ", x -> x >= 0)[0]") == F.col("b.no")).select("doc_id", "n", "s", "fp", "item_id", "hamming")
        pairs = near.join(windows, ["doc_id", "n", "s", "fp"]).join(own.select("item_id", "ih"), "item_id").withColumn("wh", as_set("hw"))
        pairs = pairs.withColumn("both", F.expr("size(array_intersect(wh, ih))").cast("double"))
        pairs = pairs.withColumn("similarity", F.col("both") / (F.size("wh") + F.size("ih") - F.col("both"))).where(F.col("similarity") >= least)
        best = pairs.groupBy("doc_id", "item_id").agg(F.min_by(F.struct(F.greatest("s", F.lit(0)).cast("long").alias("start_word"), "similarity", F.col("hamming").cast("int").alias("hamming")), F.struct(-F.col("similarity"), F.col("s"))).alias("x")).select("doc_id", "item_id", "x.*")
        found = best if found is None else found.unionByName(best)
    return found


def blocks_equal(a: str, b: str) -> str:
    """SQL for an array with the number of each block on which a and b agree, else -1."""
    return "array(" + ", ".join(f"CASE WHEN shiftrightunsigned({a} ^ {b}, {s}) & {(1 << w) - 1}L = 0 THEN {i} ELSE -1 END" for i, (s, w) in enumerate(BLOCKS)) + ")"


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    return docs.join(contaminated(spark, docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)

"""N-gram Jaccard join over documents by a token-group matrix.

A document's set holds its distinct five-word shingles (A-Z lowered, words are runs of non-space bytes; a
document of fewer words is one shingle, one without words or with a null text is empty and links with nothing).
Documents link at 100 * intersection >= 75 * union. Returned is one row per document with its set size and
component, the smallest doc_id reachable over links; equal sets share one representative.

Method. Sets that link have 3/7 of their sizes' sum in common, so each has three quarters of its shingles in common with the other.
1. A fixed third of all shingle hashes is dealt out and counted; a set of which more than a quarter of all its shingles lie in
   that third and in no other set links with none and leaves. Of the others, all shingles are counted among themselves;
   what is left of a set are the shingles that others have too, rarest first.
2. Shingles before the place where three quarters remain are a set's prefix: two sets that link share one there. Each set is
   verified against the best hub of its prefix, twice; components of the links found are the groups, of similar
   documents; large ones are cut into parts by size of the sets.
3. The matrix holds the union of each group's prefixes: for a shingle and a group the most that a member has left from there on, and
   the members' least and largest size. A set of another component looks up its prefix; what it and the members have left
   from a common shingle on bounds their overlap. Groups in which no shingle allows a link stay closed.
4. A group that qualifies is opened: the set's overlap with the union of all its members' shingles is bounded once more, then
   exact overlaps with the members are counted over the group's lists of holders.
Every step drops only what can't link, so the links between components are complete, as far as 64-bit hashes tell
shingles apart. Groups hold PART shingles at most and are opened for QUERIES sets at a time.

Defined cases: null or empty text: n_shingles 0, own component; rows that repeat a doc_id are rows of their own: each has the
component of its text; a null doc_id is never a component's id where another document has one; extra columns are ignored;
an empty table gives an empty result. Texts of any length are one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlens.llm.common import byte_view, components, materialize, row_slices, shingle_sets, tidy

#: Shingle hashes below this are counted first, a third of all.
SAMPLED = np.uint64((1 << 64) // 3)
PART, QUERIES = 200_000, 256


def _sets(batches: Iterator[pa.RecordBatch], col: str) -> Iterator[tuple[pa.RecordBatch, int, int, list[np.ndarray]]]:
    for batch in batches:
        texts = batch.column(col)
        for lo, hi in row_slices(texts):
            yield batch, lo, hi, list(shingle_sets(*byte_view(texts.slice(lo, hi - lo))))


def _digest(x: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) -> sizes of the set and of its sampled part, and a digest of the set."""
    for batch, lo, hi, sets in _sets(batches, "text"):
        n, few, sigs = [len(x) for x in sets], [int((x < SAMPLED).sum()) for x in sets], [_digest(x) for x in sets]
        ids = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_hash")]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(n, pa.int64()), pa.array(few, pa.int64()), pa.array(sigs, pa.binary()), pa.array([_key(x) for x in sigs], pa.int64())], ["doc_id", "text_hash", "n_shingles", "n_sampled", "sig", "key"])


def _key(sig: bytes | None) -> int:
    return int.from_bytes(sig[:8], "little", signed=True) if sig else 0


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> sampled shingles with a key of the set, eight bytes of its digest."""
    for _, _, _, sets in _sets(batches, "text"):
        few = [x[x < SAMPLED] for x in sets]
        keys = np.repeat(np.array([_key(_digest(x)) for x in sets], np.int64), [len(x) for x in few])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(few).view(np.int64)), pa.array(keys)], ["shingle", "key"])


def _shared_counts(buckets: int):
    """(shingle, key) in order -> how many of a set's shingles other sets hold, by task; keys of a bucket in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        last, one = None, None  # the shingle at hand, and its holder as long as there is only one

        def out() -> pa.RecordBatch:
            keys, k = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bucket = keys.view(np.uint64) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            keys, k, bucket = keys[order], k[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            offs = pa.array(np.concatenate([[0], cut, [len(keys)]]).astype(np.int32))
            first = bucket[np.concatenate([[0], cut])].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(first), pa.ListArray.from_arrays(offs, pa.array(keys)), pa.ListArray.from_arrays(offs, pa.array(k))], ["bucket", "keys", "ks"])

        for batch in batches:
            if not batch.num_rows:
                continue
            s, r = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            fresh = np.ones(len(s), bool)  # equal rows, of copies, count once
            fresh[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
            if last is not None and s[0] == last[0] and r[0] == last[1]:
                fresh[0] = False
            s, r = s[fresh], r[fresh]
            if not len(s):
                continue
            twin = np.zeros(len(s), bool)
            same = s[1:] == s[:-1]
            twin[1:] |= same
            twin[:-1] |= same
            if last is not None and s[0] == last[0]:
                if one is not None:
                    held.append(np.array([one], np.int64))
                twin[0] = True
            held.append(r[twin])
            size += len(held[-1])
            one = None if twin[-1] else int(r[-1])
            last = (s[-1], r[-1])
            if size > 2_000_000:
                yield out()
                size = 0
        if sum(map(len, held)):
            yield out()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of a bucket of keys, counted by task -> (key, k)."""
    for batch in batches:
        for parts in batch.column(0):
            rows = parts.values
            keys, at = np.unique(rows.field("keys").flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            k = np.bincount(at, weights=rows.field("ks").flatten().to_numpy(zero_copy_only=False), minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(k.astype(np.int64))], ["key", "k"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lo, hi, sets in _sets(batches, "text"):
        n = [len(x) for x in sets]
        cols = [pa.array(np.repeat(batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False), n)) for c in ("node", "n")]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), *cols], ["shingle", "node", "n"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(members, queries) of groups -> a link of each query to a member, if there is one."""
    for batch in batches:
        found_a, found_b = [], []
        for members, queries in zip(batch.column("members"), batch.column("queries"), strict=True):
            m, q = members.values, queries.values
            nodes, sizes = (m.field(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
            held = m.field("shingles")
            flat = held.flatten().to_numpy(zero_copy_only=False)
            who = np.repeat(np.arange(len(nodes)), np.diff(held.offsets.to_numpy()))
            order = np.argsort(flat, kind="stable")
            flat, who = flat[order], who[order]
            union, first = np.unique(flat, return_index=True)
            last = np.append(first[1:], len(flat))
            for node, n, shingles in zip(q.field("node").to_pylist(), q.field("n").to_pylist(), q.field("shingles"), strict=True):
                own = shingles.values.to_numpy(zero_copy_only=False)
                at = np.searchsorted(union, own)
                at[at == len(union)] = 0
                at = at[union[at] == own]
                if 7 * len(at) < 3 * (n + int(sizes.min())):
                    continue  # not even the union of all members holds enough
                counts = last[at] - first[at]
                ends = np.cumsum(counts)
                lists = who[np.repeat(first[at] - ends + counts, counts) + np.arange(counts.sum())]
                hit = np.flatnonzero(7 * np.bincount(lists, minlength=len(nodes)) >= 3 * (n + sizes))
                if len(hit):
                    found_a.append(node)
                    found_b.append(int(nodes[hit[0]]))
        yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])


def _grouped(nodes: DataFrame, links: DataFrame, spark: SparkSession) -> DataFrame:
    """nodes (with node) and the component that links give each."""
    found = components(spark, links, "jaccard-cc")
    return nodes.join(found, nodes["node"] == found["node"], "left").select(*(nodes[c] for c in nodes.columns), F.coalesce("component", nodes["node"]).alias("component"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: exact overlaps of what sets share with any other."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    return pairs.join(one, "a").join(two, "b").where("7 * size(array_intersect(sa, sb)) >= 3 * (na + nb)").select("a", "b")


def _best_hubs(prefix: DataFrame, hub: Column) -> DataFrame:
    """(a, b): for each set the hub that it shares most shingles of its prefix with, of fitting size and another component."""
    hubs = prefix.groupBy("shingle").agg(F.min(hub).alias("hub"))
    pairs = prefix.join(hubs, "shingle").where("node <> hub.node AND component <> hub.component AND 4 * least(n, hub.n) >= 3 * greatest(n, hub.n)")
    pairs = pairs.groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.count("*").alias("k"))
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("k", -F.col("b"))).alias("b"))


def _linkable(spark: SparkSession, src: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, sig, n, shingles): sets that may link, with the shingles that other such sets have too, rarest first."""
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = src.select("text").mapInArrow(tidy(_sampled), "shingle long, key long").repartition("shingle").sortWithinPartitions("shingle", "key")
    counted = dealt.mapInArrow(tidy(_shared_counts(max(1, parts // 4))), "bucket long, keys array<bigint>, ks array<bigint>")
    summed = counted.groupBy("bucket").agg(F.collect_list(F.struct("keys", "ks")).alias("parts")).select("parts").mapInArrow(tidy(_summed), "key long, k long")
    some = classes.join(summed, "key", "left").where("coalesce(k, 0) >= n_sampled - floor(n / 4)").select("sig", "n", "rep", "text_hash")
    some = materialize(spark, some.withColumn("node", F.monotonically_increasing_id()), "jaccard-some")
    # rows that repeat an id and a text are one set; never a broadcast, as these sets grow with the table
    texts = src.withColumn("rep", F.coalesce("doc_id", F.lit(0))).join(some.hint("merge"), ["rep", "text_hash"]).select("node", "n", "text")
    shingles = texts.mapInArrow(tidy(_shingle_rows), "shingle long, node long, n long")
    common = shingles.withColumn("df", F.count("*").over(Window.partitionBy("shingle"))).where("df > 1")
    sets = common.groupBy("node", "n").agg(F.array_sort(F.collect_set(F.struct("df", "shingle"))).alias("x")).where("4 * size(x) >= 3 * n")
    sets = sets.select("node", "n", F.col("x.shingle").alias("shingles"))
    return sets.join(some.select("node", "sig"), "node")


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id): set_id is the smallest doc_id with the same set."""
    return _components(spark, docs, id_col, text_col).select("doc_id", "n_shingles", "component_id", "set_id")


def _components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: (doc_id, text_hash, n_shingles, component_id, set_id)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("text_hash", F.xxhash64("text", F.isnull("doc_id")))
    sketch = materialize(spark, src.mapInArrow(tidy(_sketch), "doc_id long, text_hash long, n_shingles long, n_sampled long, sig binary, key long"), "jaccard-sketch")
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("rep"), "text_hash"))
    classes = sketch.where("n_shingles > 0").groupBy("sig", "key").agg(least.alias("at"), F.min("doc_id").alias("set_id"), F.first("n_shingles").alias("n"), F.first("n_sampled").alias("n_sampled"))
    classes = materialize(spark, classes.select("sig", "key", "set_id", "n", "n_sampled", "at.rep", "at.text_hash"), "jaccard-classes")

    sets = materialize(spark, _linkable(spark, src, classes), "jaccard-sets")
    shared, least_shared = F.size("shingles"), F.ceil(F.col("n") * 3 / 4)
    # of a set's prefix, n - least_shared + 1 shingles, those come first that no other set has
    head = F.slice("shingles", 1, F.greatest(F.lit(0), shared - least_shared + 1).cast("int"))
    prefix = sets.select("node", "n", (1 - shared / F.col("n")).alias("alone"), shared.alias("m"), F.posexplode(head).alias("i", "shingle"))
    prefix = materialize(spark, prefix.select("node", "n", "m", "alone", "shingle", (F.col("m") - F.col("i")).alias("rest")), "jaccard-prefixes")
    links, nodes = None, sets.select("node")
    grouped = nodes.withColumn("component", F.col("node"))
    for _ in range(2):
        sized = grouped.join(grouped.groupBy("component").agg(F.count("*").alias("size")), "component")
        # the hub of a shingle: of its holders one of the largest group, with the fewest shingles that no other set has
        hub = F.struct(-F.col("size"), "alone", "node", "n", "component")
        best = _best_hubs(prefix.join(sized, "node"), hub)
        more = materialize(spark, _verified(best, sets), "jaccard-links")
        links = more if links is None else links.unionByName(more)
        grouped = materialize(spark, _grouped(nodes, links, spark), "jaccard-groups")
    more = materialize(spark, _across(spark, sets, prefix, grouped), "jaccard-links")
    grouped = _grouped(nodes, links.unionByName(more), spark)

    known = sets.select("node", "sig").join(grouped, "node").join(classes.select("sig", "set_id"), "sig")
    least = known.groupBy("component").agg(F.min("set_id").alias("component_id"))
    named = known.join(least, "component").select("sig", "component_id")
    own = classes.select("sig", "set_id").join(named, "sig", "left").select("sig", "set_id", F.coalesce("component_id", "set_id").alias("component_id"))
    out = sketch.join(own, "sig", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("set_id", "doc_id").alias("set_id"))


def _across(spark: SparkSession, sets: DataFrame, prefix: DataFrame, grouped: DataFrame) -> DataFrame:
    """Links (a, b) between different components, one for each set and group that have any."""
    shared = F.size("shingles")
    sizes = sets.select("node", "n", shared.alias("m")).join(grouped, "node")
    total = sizes.groupBy("component").agg(F.sum("m").alias("all"), F.count("*").alias("size"))
    # parts of a component hold sets of about one size
    band = F.floor(F.log(1.2, F.col("n")))
    parts = F.greatest(F.lit(1), F.ceil(F.col("all") / PART)).cast("int")
    part = F.when(parts > 1, F.struct(band.alias("band"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("no"))).otherwise(F.struct(F.lit(0).cast("long").alias("band"), F.lit(0).alias("no")))
    placed = materialize(spark, sizes.join(total, "component").select("node", "component", "size", part.alias("part")), "jaccard-parts")
    rows = prefix.join(placed, "node")
    matrix = rows.groupBy("shingle", "component", "size", "part").agg(F.max("rest").alias("most"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    q, g = rows.alias("q"), matrix.alias("g")
    # of two components the smaller one asks
    asks = "(q.size < g.size OR q.size = g.size AND q.component < g.component)"
    fits = "4 * g.hi >= 3 * q.n AND 3 * g.lo <= 4 * q.n AND 7 * least(q.rest, g.most) >= 3 * (q.n + greatest(g.lo, ceil(q.n * 3 / 4)))"
    open_ = q.join(g, F.expr(f"q.shingle = g.shingle AND {asks} AND {fits}"))
    open_ = materialize(spark, open_.select("q.node", "g.component", "g.part").distinct(), "jaccard-open")
    some = open_.select("component", "part").distinct()
    entry = F.struct("node", "n", "shingles").alias("entry")
    members = placed.join(some, ["component", "part"], "left_semi").join(sets.select("node", entry), "node").groupBy("component", "part").agg(F.collect_list("entry").alias("members"))
    many = open_.groupBy("component", "part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks"))
    asked = open_.join(many, ["component", "part"]).withColumn("chunk", F.expr("pmod(xxhash64(node), chunks)"))
    queries = asked.join(sets.select("node", entry), "node").groupBy("component", "part", "chunk").agg(F.collect_list("entry").alias("queries"))
    return members.join(queries, ["component", "part"]).select("members", "queries").mapInArrow(tidy(_open), "a long, b long")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; of rows that repeat it one."""
    names = docs.columns
    one, two = (f"{x}_{'_'.join(names)}" for x in ("hash", "row"))  # names that docs can't have
    first = _components(spark, docs).where("doc_id <=> component_id").select("doc_id", F.col("text_hash").alias(one)).distinct()
    first = first.select(F.col("doc_id").alias(two), one)
    keyed = docs.withColumn(one, F.xxhash64(F.col("text").cast("string"), F.isnull("doc_id")))
    kept = keyed.join(first, [keyed["doc_id"].cast("long").eqNullSafe(first[two]), keyed[one] == first[one]], "left_semi")
    # documents without an id are told apart by their texts
    key = [F.col("doc_id"), F.when(F.isnull("doc_id"), F.col(one))]
    return kept.withColumn(two, F.row_number().over(Window.partitionBy(*key).orderBy(one, F.xxhash64(*names)))).where(F.col(two) == 1).select(*names)

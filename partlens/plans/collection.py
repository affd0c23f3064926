"""Collection of listings as tables: cost of a run, order and escalation of queries, ledgers of chunks, resume and recovery, jobs.

The network is out of scope: line items stand for what queries would return, events for attempts. What a run may do next
follows from its tables alone, so any of these can be asked again after a crash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlens.plans import cleaning

#: Unique listings that end an item's escalation, most that are kept, pages and markets of a query, quota margin.
ENOUGH, CAP, PAGES, MARKETS, MARGIN = 5, 50, 3, ("EBAY_DE", "EBAY_US"), 1.2
PREFIXES = ("Cal", "Calibre", "Caliber", "Kaliber")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dry_run_cost(spark, d):
    """Calls that a run would need at best, one a market, and at worst, all queries with all pages; without any network."""
    q = cleaning.query_ladder(spark, d).where("tier > 0")
    items = cleaning.checked(cleaning.raw(spark, d)).where("status <> 'FAIL'").select("id")
    n = items.join(q.groupBy("id").agg(F.count("*").alias("n")), "id", "left")
    tiers = [F.coalesce(F.sum(F.col(f"t{i}")), F.lit(0)).alias(f"tier_{i}") for i in range(1, 6)]
    by = q.groupBy("id").agg(*[F.count_if(F.col("tier") == i).alias(f"t{i}") for i in range(1, 6)])
    x = n.join(by, "id", "left")
    return x.agg(F.count("*").alias("items"), F.sum(F.coalesce("n", F.lit(0))).alias("queries"), F.count_if(F.col("n").isNull()).alias("without"), (F.count("n") * len(MARKETS)).alias("best_calls"), (F.sum(F.coalesce("n", F.lit(0))) * PAGES * len(MARKETS)).alias("worst_calls"), *tiers)


def query_order(spark, d):
    """The order in which an item's queries run: by tier, within tier 2 as they were made and not by letters."""
    q = cleaning.query_ladder(spark, d).where("tier > 0")
    rank = F.coalesce(*[F.when((F.col("tier") == 2) & F.col("query").contains(f" {w} "), i) for i, w in enumerate(PREFIXES)], F.when(F.col("tier") == 2, len(PREFIXES)), F.lit(0))
    return q.select("id", "tier", "query", F.row_number().over(Window.partitionBy("id").orderBy("tier", rank, "query")).cast("long").alias("place"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """(item, tier, listing): what each tier's query finds."""
    return _t(spark, d, "lineitem").where("l_linenumber <= 5").select(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("tier"), F.col("l_suppkey").alias("listing")).distinct()


def tier_escalation(spark, d):
    """How far each item's escalation goes: tiers run until enough unique listings are found or none is left; a listing counts in its
    lowest tier; of many listings the first are kept; calls past an item's budget are not made."""
    first = _results(spark, d).groupBy("item", "listing").agg(F.min("tier").alias("tier"))
    found = first.groupBy("item", "tier").agg(F.count("*").alias("n"))
    items = _t(spark, d, "part").select(F.col("p_partkey").alias("item"), (F.col("p_partkey") % 6 + 1).alias("budget"))
    grid = items.withColumn("tier", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])))
    w = Window.partitionBy("item").orderBy("tier")
    x = grid.join(found, ["item", "tier"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    x = x.withColumn("before", F.sum("n").over(w) - F.col("n"))
    x = x.withColumn("runs", (F.col("before") < ENOUGH) & (F.col("tier") <= F.col("budget")))
    y = x.groupBy("item").agg(F.count_if("runs").alias("calls"), F.sum(F.when(F.col("runs"), F.col("n")).otherwise(0)).alias("unique"), F.first("budget").alias("budget"))
    why = F.when(F.col("unique") >= ENOUGH, "ENOUGH").when(F.col("calls") == 5, "EXHAUSTED").otherwise("BUDGET")
    return y.select("item", "calls", F.least("unique", F.lit(CAP)).alias("kept"), why.alias("stop"))


def listing_lowest_tier(spark, d):
    """Of a listing that several tiers find the lowest one is kept; ties keep the first row."""
    li = _t(spark, d, "lineitem")
    return li.groupBy("l_partkey", "l_suppkey").agg(F.min_by(F.struct("l_linenumber", "l_orderkey", "l_returnflag"), F.struct("l_linenumber", "l_orderkey", "l_extendedprice")).alias("x")).select("l_partkey", "l_suppkey", F.col("x.l_linenumber").alias("tier"), F.col("x.l_orderkey").alias("source"), F.col("x.l_returnflag").alias("flag"))


#: Expressions over events: chunks of a collection, their files as recorded and as they are now.
CHUNK = {
    "item": "event_id", "chunk": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'c' || CAST(event_id % 900 AS STRING) END", "known": "event_id % 900 % 13 > 0", "ingested": "event_id % 900 % 3 = 0",
    "file": "CASE WHEN event_id % 900 % 17 = 0 THEN NULL ELSE 'f' || CAST(event_id % 900 AS STRING) END", "recorded": "CASE WHEN event_id % 900 % 19 = 0 THEN NULL ELSE event_id % 900 END",
    "present": "event_id % 900 % 23 > 0", "now": "CASE WHEN event_id % 900 % 29 = 0 THEN -1 ELSE event_id % 900 END",
}


def resume_proof(spark, d):
    """Whether an attempt may be skipped on resume: only if its rows are ingested, or its file is there with the hash recorded."""
    x = _t(spark, d, "events").selectExpr(*[f"{e} AS {n}" for n, e in CHUNK.items()])
    why = (
        F.when(F.col("chunk").isNull(), "retry: no chunk recorded").when(~F.col("known"), "retry: chunk never written").when(F.col("ingested"), "skip: ingested")
        .when(F.col("file").isNull() | ~F.col("present"), "retry: file missing").when(F.col("recorded").isNull(), "retry: no hash recorded").when(F.col("recorded") != F.col("now"), "retry: file changed").otherwise("skip: file proven")
    )
    return x.select("item", why.alias("verdict"), why.startswith("skip").alias("skip"))


def chunk_conflicts(spark, d):
    """Entries of a ledger written again: equal ones change nothing, others of the same key are conflicts and not written."""
    o = _t(spark, d, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("key"), F.struct("o_orderpriority", "o_orderstatus").alias("body"), "o_orderkey").groupBy("key").agg(F.min_by("body", "o_orderkey").alias("old"))
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key"), F.struct("o_orderpriority", "o_orderstatus").alias("body"), "o_orderkey").groupBy("key").agg(F.min_by("body", "o_orderkey").alias("new"))
    verdict = F.when(F.col("old").isNull(), "INSERTED").when(F.col("old").eqNullSafe(F.col("new")), "UNCHANGED").otherwise("CONFLICT")
    return new.join(old, "key", "left").select("key", verdict.alias("verdict"))


def orphan_recovery(spark, d):
    """What can be told of chunks whose files outlived their ledger entry, from rows of the file and the manifest.

    Both there: pairs with rows, if the counts agree, and pairs that the manifest says had none. File alone: pairs with rows only,
    as no rows prove nothing. Manifest alone: nothing, the rows are gone.
    """
    li = _t(spark, d, "lineitem")
    rows = li.where("l_orderkey % 4 <> 3").groupBy(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("pair")).agg(F.count("*").alias("rows"))
    files = rows.select("chunk", F.lit(True).alias("has_file")).distinct()
    said = li.where("l_orderkey % 4 <> 2").groupBy(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("pair")).agg((F.count("*") + F.max(F.when(F.col("l_orderkey") % 20 == 5, 1).otherwise(0))).alias("claimed"))
    zero = said.select("chunk").distinct().select("chunk", F.lit(99).alias("pair"), F.lit(0).cast("long").alias("claimed"))
    said = said.unionByName(zero)
    valid = said.join(files, "chunk", "left")
    both = rows.join(valid, ["chunk", "pair"], "full").join(files.withColumnRenamed("has_file", "f"), "chunk", "left").join(said.select("chunk", F.lit(True).alias("m")).distinct(), "chunk", "left")
    verdict = (
        F.when(F.col("f").isNull(), "RETRY_NO_FILE").when(F.col("m").isNull(), "FROM_ROWS").when(F.col("claimed") == 0, "ZERO_FROM_MANIFEST")
        .when(F.col("rows") == F.col("claimed"), "CONFIRMED").otherwise("RETRY_COUNTS_DIFFER")
    )
    return both.groupBy("chunk").agg(*[F.count_if(verdict == v).alias(v.lower()) for v in ("RETRY_NO_FILE", "FROM_ROWS", "ZERO_FROM_MANIFEST", "CONFIRMED", "RETRY_COUNTS_DIFFER")])


def batch_reconcile(spark, d):
    """Chunks against the log of what was ingested: the latest successful entry of the same type, name and hash marks one as done."""
    o = _t(spark, d, "orders")
    chunks = o.select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("name"), (F.col("o_orderkey") % 5).alias("hash"))
    log = o.select(F.col("o_custkey").alias("name"), (F.col("o_orderkey") % 7 % 5).alias("hash"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"), "o_orderdate")
    done = log.where("status = 'success'").groupBy("name", "hash").agg(F.max("o_orderdate").alias("at"))
    return chunks.join(done, ["name", "hash"], "left").select("chunk", F.date_format("at", "yyyy-MM-dd").alias("ingested"))


def batch_completion(spark, d):
    """Of each batch whether all its pairs of item and market were tried, whichever others were too, and whether it is proven that
    nothing was found: all entries sound, calls made, no result."""
    o = _t(spark, d, "orders")
    x = o.select(F.date_format("o_orderdate", "yyyy-MM").alias("batch"), "o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 3).alias("calls"), F.when(F.month("o_orderdate") == 3, 0).otherwise(F.col("o_custkey") % 2).alias("results"), (F.col("o_orderkey") % 400 > 0).alias("sound"))
    batches = x.select("batch").distinct()
    expected = batches.crossJoin(F.broadcast(x.where("o_orderpriority <= '3'").select("o_orderpriority").distinct())).crossJoin(F.broadcast(x.where("o_orderstatus <> 'P'").select("o_orderstatus").distinct()))  # five priorities by three statuses
    done = x.where("calls > 0").select("batch", "o_orderpriority", "o_orderstatus").distinct()
    lacking = expected.join(done, ["batch", "o_orderpriority", "o_orderstatus"], "left_anti").groupBy("batch").agg(F.count("*").alias("lacking"))
    proof = x.groupBy("batch").agg((F.bool_and("sound") & (F.sum("calls") > 0) & (F.sum("results") == 0)).alias("proven_empty"))
    return proof.join(lacking, "batch", "left").select("batch", F.coalesce("lacking", F.lit(0)).alias("lacking"), F.col("lacking").isNull().alias("complete"), "proven_empty")


def chunk_stop_reasons(spark, d):
    """Why a chunk of a run ends, by the first that holds: quota unknown or used up, calls planned beyond the safe budget, all done,
    failures in a row, time, else it goes on. The safe budget keeps a margin of the remaining quota."""
    o = _t(spark, d, "orders")
    quota = F.when(F.col("o_orderkey") % 15 == 0, None).otherwise(F.col("o_custkey") % 400)
    x = o.select("o_orderkey", quota.alias("quota"), F.floor(F.col("o_totalprice") / 2000).alias("planned"), (F.col("o_orderkey") % 9).alias("left"), (F.col("o_custkey") % 7).alias("failures"), F.dayofmonth("o_orderdate").alias("minutes"))
    x = x.withColumn("budget", F.greatest(F.lit(0), F.floor(F.col("quota") / MARGIN)))
    why = (
        F.when(F.col("left") == 0, "ALL_DONE").when(F.col("quota").isNull(), "QUOTA_UNKNOWN").when(F.col("budget") == 0, "QUOTA_EXHAUSTED").when(F.col("planned") > F.col("budget"), "CALL_BUDGET")
        .when(F.col("failures") >= 5, "REPEATED_FAILURES").when(F.col("minutes") > 25, "TIME").otherwise("CONTINUE")
    )
    return x.select("o_orderkey", "budget", why.alias("stop"))


def job_queue(spark, d):
    """Jobs from their events: state, steps with seconds, and which one is next: the oldest that is queued, if none runs."""
    e = _t(spark, d, "events").withColumn("job", F.col("user_id"))
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    x = e.groupBy("job").agg(F.min("ts").alias("queued"), n("error").alias("errors"), n("purchase").alias("done"), n("signup").alias("started"), F.count("*").alias("steps"), F.round(F.sum("value"), 2).alias("seconds"))
    state = F.when(F.col("errors") % 3 == 1, "FAILED").when(F.col("done") % 4 == 0, "QUEUED").when(F.col("started") % 5 == 0, "RUNNING").otherwise("SUCCEEDED")
    x = x.withColumn("state", state)
    head = x.where("state = 'QUEUED'").agg(F.min_by("job", F.struct("queued", "job")).alias("head"))
    return x.crossJoin(F.broadcast(head)).select("job", "state", "steps", "seconds", (F.col("job") == F.col("head")).alias("is_next"))  # one row


def seed_if_empty(spark, d):
    """Fixed cases go into a review table only if it is empty; policies start inactive."""
    o = _t(spark, d, "orders")
    seeds = spark.range(18).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("key"), F.lit(False).alias("active"))
    full, empty = o.where("o_orderkey < 3"), o.where("o_orderkey < 0")
    out = None
    for name, table in (("full", full), ("empty", empty)):
        have = table.limit(1).agg(F.count("*").alias("n"))
        one = seeds.crossJoin(F.broadcast(have)).where("n = 0").select(F.lit(name).alias("t"), "key", "active").unionByName(table.select(F.lit(name).alias("t"), F.col("o_orderkey").cast("string").alias("key"), F.lit(True).alias("active")))
        out = one if out is None else out.unionByName(one)
    return out


def sold_cards(spark, d):
    """Listing cards on pages as rows: each list entry's link, label without markup, and whether it leads off the page's host."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    card = F.regexp_extract_all("html", F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), 1)
    x = _t(spark, d, "pages").select("page_id", host.alias("host"), F.posexplode(F.filter(card, lambda c: c.rlike("(?i)<a\\b"))).alias("pos", "card"))
    label = F.trim(F.regexp_replace(F.regexp_replace("card", r"<[^>]*>", " "), r"\s+", " "))
    return x.select("page_id", "pos", F.regexp_extract("card", r"(?i)<a\b[^>]*\bhref=[\"']([^\"']*)[\"']", 1).alias("href"), label.alias("label"))


# ---------------------------------------------------------------- oracles
_LADDER = cleaning.ORACLE_SQL["query_ladder"]
_RES = "r AS (SELECT DISTINCT l_partkey AS item, l_linenumber AS tier, l_suppkey AS listing FROM lineitem WHERE l_linenumber <= 5)"
_CH = "x AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CHUNK.items()) + " FROM events)"
_VERDICT = "CASE WHEN chunk IS NULL THEN 'retry: no chunk recorded' WHEN NOT known THEN 'retry: chunk never written' WHEN ingested THEN 'skip: ingested' WHEN file IS NULL OR NOT present THEN 'retry: file missing' WHEN recorded IS NULL THEN 'retry: no hash recorded' WHEN recorded <> now THEN 'retry: file changed' ELSE 'skip: file proven' END"
QUERIES = {f.__name__: f for f in (dry_run_cost, query_order, tier_escalation, listing_lowest_tier, resume_proof, chunk_conflicts, orphan_recovery, batch_reconcile, batch_completion, chunk_stop_reasons, job_queue, seed_if_empty, sold_cards)}
ORACLE_SQL = {
    "dry_run_cost": f"WITH q AS (SELECT * FROM ({_LADDER}) WHERE tier > 0), v AS (SELECT id FROM ({cleaning.ORACLE_SQL['inventory_validated']}) WHERE status <> 'FAIL'), n AS (SELECT id, count(*) AS n FROM q GROUP BY 1) SELECT count(*) AS items, CAST(sum(coalesce(n, 0)) AS BIGINT) AS queries, count(*) FILTER (WHERE n IS NULL) AS without, count(n) * 2 AS best_calls, CAST(sum(coalesce(n, 0)) * 6 AS BIGINT) AS worst_calls, " + ", ".join(f"(SELECT count(*) FROM q WHERE tier = {i}) AS tier_{i}" for i in range(1, 6)) + " FROM v LEFT JOIN n USING (id)",
    "query_order": f"SELECT id, tier, query, row_number() OVER (PARTITION BY id ORDER BY tier, CASE WHEN tier = 2 THEN CASE WHEN contains(query, ' Cal ') THEN 0 WHEN contains(query, ' Calibre ') THEN 1 WHEN contains(query, ' Caliber ') THEN 2 ELSE 3 END ELSE 0 END, query) AS place FROM ({_LADDER}) WHERE tier > 0",
    "tier_escalation": f"WITH {_RES}, f AS (SELECT item, listing, min(tier) AS tier FROM r GROUP BY 1, 2), g AS (SELECT item, tier, count(*) AS n FROM f GROUP BY 1, 2), x AS (SELECT p_partkey AS item, t AS tier, p_partkey % 6 + 1 AS budget, coalesce(n, 0) AS n FROM part, (SELECT unnest([1, 2, 3, 4, 5]) AS t) LEFT JOIN g ON g.item = p_partkey AND g.tier = t), y AS (SELECT *, sum(n) OVER (PARTITION BY item ORDER BY tier) - n < {ENOUGH} AND tier <= budget AS runs FROM x), z AS (SELECT item, count(*) FILTER (WHERE runs) AS calls, CAST(coalesce(sum(n) FILTER (WHERE runs), 0) AS BIGINT) AS u FROM y GROUP BY 1) SELECT item, calls, least(u, {CAP}) AS kept, CASE WHEN u >= {ENOUGH} THEN 'ENOUGH' WHEN calls = 5 THEN 'EXHAUSTED' ELSE 'BUDGET' END AS stop FROM z",
    "listing_lowest_tier": "SELECT l_partkey, l_suppkey, l_linenumber AS tier, l_orderkey AS source, l_returnflag AS flag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_linenumber, l_orderkey, l_extendedprice) = 1",
    "resume_proof": f"WITH {_CH} SELECT item, {_VERDICT} AS verdict, starts_with({_VERDICT}, 'skip') AS skip FROM x",
    "chunk_conflicts": "WITH o AS (SELECT o_custkey AS key, arg_min(o_orderpriority || o_orderstatus, o_orderkey) AS old FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS key, arg_min(o_orderpriority || o_orderstatus, o_orderkey) AS new FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT key, CASE WHEN old IS NULL THEN 'INSERTED' WHEN old = new THEN 'UNCHANGED' ELSE 'CONFLICT' END AS verdict FROM n LEFT JOIN o USING (key)",
    "orphan_recovery": "WITH r AS (SELECT l_orderkey AS chunk, l_linenumber AS pair, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT chunk, pair, n, chunk % 4 <> 3 AS f, chunk % 4 <> 2 AS m, n + CASE WHEN chunk % 20 = 5 THEN 1 ELSE 0 END AS claimed FROM r), z AS (SELECT DISTINCT chunk, 99 AS pair, 0 AS n, chunk % 4 <> 3 AS f, true AS m, 0 AS claimed FROM m WHERE m), u AS (SELECT * FROM m UNION ALL SELECT * FROM z) SELECT chunk, count(*) FILTER (WHERE NOT f) AS retry_no_file, count(*) FILTER (WHERE f AND NOT m) AS from_rows, count(*) FILTER (WHERE f AND m AND claimed = 0) AS zero_from_manifest, count(*) FILTER (WHERE f AND m AND claimed > 0 AND n = claimed) AS confirmed, count(*) FILTER (WHERE f AND m AND claimed > 0 AND n <> claimed) AS retry_counts_differ FROM u GROUP BY 1",
    "batch_reconcile": "WITH d AS (SELECT o_custkey AS name, o_orderkey % 7 % 5 AS hash, max(o_orderdate) AS at_ FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) SELECT o_orderkey AS chunk, strftime(at_, '%Y-%m-%d') AS ingested FROM orders LEFT JOIN d ON name = o_custkey AND hash = o_orderkey % 5",
    "batch_completion": "WITH x AS (SELECT strftime(o_orderdate, '%Y-%m') AS batch, o_orderpriority AS p, o_orderstatus AS s, o_custkey % 3 AS calls, CASE WHEN month(o_orderdate) = 3 THEN 0 ELSE o_custkey % 2 END AS results, o_orderkey % 400 > 0 AS sound FROM orders), e AS (SELECT DISTINCT b.batch, p.p, s.s FROM x b, (SELECT DISTINCT p FROM x WHERE p <= '3') p, (SELECT DISTINCT s FROM x WHERE s <> 'P') s EXCEPT SELECT batch, p, s FROM x WHERE calls > 0), l AS (SELECT batch, count(*) AS lacking FROM e GROUP BY 1), g AS (SELECT batch, bool_and(sound) AND sum(calls) > 0 AND sum(results) = 0 AS proven_empty FROM x GROUP BY 1) SELECT batch, coalesce(lacking, 0) AS lacking, lacking IS NULL AS complete, proven_empty FROM g LEFT JOIN l USING (batch)",
    "chunk_stop_reasons": "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 15 > 0 THEN o_custkey % 400 END AS quota, CAST(floor(o_totalprice / 2000) AS BIGINT) AS planned, o_orderkey % 9 AS todo, o_custkey % 7 AS failures, day(o_orderdate) AS minutes FROM orders), y AS (SELECT *, CASE WHEN quota IS NULL THEN 0 ELSE CAST(floor(quota / 1.2e0) AS BIGINT) END AS budget FROM x) SELECT o_orderkey, budget, CASE WHEN todo = 0 THEN 'ALL_DONE' WHEN quota IS NULL THEN 'QUOTA_UNKNOWN' WHEN budget = 0 THEN 'QUOTA_EXHAUSTED' WHEN planned > budget THEN 'CALL_BUDGET' WHEN failures >= 5 THEN 'REPEATED_FAILURES' WHEN minutes > 25 THEN 'TIME' ELSE 'CONTINUE' END AS stop FROM y",
    "job_queue": "WITH x AS (SELECT user_id AS job, min(ts) AS queued, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type = 'signup') AS s, count(*) AS steps, round(sum(value), 2) AS seconds FROM events GROUP BY 1), y AS (SELECT *, CASE WHEN e % 3 = 1 THEN 'FAILED' WHEN p % 4 = 0 THEN 'QUEUED' WHEN s % 5 = 0 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS state FROM x) SELECT job, state, steps, seconds, job = (SELECT job FROM y WHERE state = 'QUEUED' ORDER BY queued, job LIMIT 1) AS is_next FROM y",
    "seed_if_empty": "SELECT 'empty' AS t, 'S' || i AS key, false AS active FROM range(18) r(i) UNION ALL SELECT 'full', CAST(o_orderkey AS VARCHAR), true FROM orders WHERE o_orderkey < 3",
    "sold_cards": "WITH c AS (SELECT page_id, list_filter(regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1), lambda c: regexp_matches(c, '(?i)<a\\b')) AS cards FROM pages), x AS (SELECT page_id, unnest(generate_series(1, len(cards))) - 1 AS pos, unnest(cards) AS card FROM c) SELECT page_id, CAST(pos AS INT) AS pos, regexp_extract(card, '(?i)<a\\b[^>]*\\bhref=[\"'']([^\"'']*)[\"'']', 1) AS href, trim(regexp_replace(regexp_replace(card, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM x",
}

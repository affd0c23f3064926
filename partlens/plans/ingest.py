"""Sources, ledger and sinks as queries: rows of the tables are written as the files that a source expects, read back by it, and
written by a sink.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlens.operators import sinks as S
from partlens.operators.relational import latest_per_key
from partlens.plans import cleaning
from partlens.sources import files as X
from partlens.sources import paged
from partlens.storage import fresh_path


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def csv_strings(spark, d):
    """Customers through two CSV files of different column order, all text, with the file each row came from."""
    path = fresh_path(spark, "csv")
    c = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit(' "'), F.col("c_name"), F.lit('", ')).alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"))
    X.write_csv(c.where("id % 2 = 0"), f"{path}/even", 1)
    X.write_csv(c.where("id % 2 = 1").select("segment", "id", "name"), f"{path}/odd", 2)
    rows = X.read_strings(spark, path, ["id", "name", "segment", "none"])
    return rows.select("id", "name", "segment", "none", F.regexp_extract("file", r"/(even|odd)/[^/]*$", 1).alias("folder"))


def source_inventory(spark, d):
    """Inventory lines from CSV: equal lines count once, each has a hash and a number after those of the rows before."""
    path = fresh_path(spark, "inventory")
    X.write_csv(cleaning.raw(spark, d).select(F.col("brand").alias("rolex/tudor"), F.col("caliber").alias("calibre"), F.col("part").alias("p-number"), "stock"), path, 3)
    cols = ["rolex/tudor", "calibre", "p-number", "stock"]
    rows = X.read_strings(spark, path, cols).withColumn("row_hash", X.row_hash(*[f"`{c}`" for c in cols]))
    one = latest_per_key(rows, ["row_hash"], F.desc("file")).select("row_hash", *[F.col(f"`{c}`").alias(n) for c, n in zip(cols, ("brand", "caliber", "part", "stock"), strict=True)])
    return S.numbered(spark, one, [F.col("row_hash")], "id", 1001)


_PRICE = "CASE event_id % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN '' ELSE CAST(user_id AS STRING) || '.5' END"


def source_broad_listings(spark, d):
    """Active listings: numbers coerced, rows known by their hash left out, a changed listing is a new row."""
    path = fresh_path(spark, "broad")
    e = _t(spark, d, "events").selectExpr("CAST(user_id % 300 AS STRING) AS item_id", "event_type AS title", f"{_PRICE} AS price_value", "'EUR' AS price_currency", "CAST(event_id % 4 AS STRING) AS condition_id")
    X.write_csv(e, path, 2)
    rows = X.numbers(X.read_strings(spark, path, ["item_id", "title", "price_value", "price_currency", "condition_id"]), "price_value", "condition_id")
    rows = rows.withColumn("row_hash", X.row_hash("item_id", "title", "price_value", "price_currency"))
    known = rows.where("item_id % 10 = 3").select("row_hash")
    return X.new_rows(rows, known, "row_hash", F.asc("condition_id")).select("item_id", "title", "price_value", "condition_id")


def source_aggregate_history(spark, d):
    """Aggregated history: a row's own source where it names one, else the file that holds it."""
    path = fresh_path(spark, "history")
    p = _t(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS title", "CAST(p_size AS STRING) AS total_sold", "CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL ELSE ' page_' || p_size || ' ' END AS source_file")
    X.write_csv(p, f"{path}/terapeak", 1)
    rows = X.read_strings(spark, path, ["title", "total_sold", "source_file"])
    return rows.select("title", F.col("total_sold").try_cast("int").alias("total_sold"), X.provenance(F.col("source_file"), F.regexp_extract("file", r"/([^/]+)/[^/]*$", 1)).alias("source"))


def source_sold_listings(spark, d):
    """Sold listings: flags from a few spellings of true, one row for each item number that isn't known yet."""
    path = fresh_path(spark, "sold")
    o = _t(spark, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS item_number", "CAST(o_orderkey AS STRING) AS page", "CASE o_orderkey % 6 WHEN 0 THEN '1' WHEN 1 THEN 'true' WHEN 2 THEN ' TRUE ' WHEN 3 THEN 'yes' WHEN 4 THEN '' ELSE '0' END AS is_sold", "CASE WHEN o_orderkey % 9 = 0 THEN 'EUR' ELSE CAST(o_orderkey AS STRING) END AS price_eur")
    X.write_csv(o, path, 2)
    rows = X.numbers(X.read_strings(spark, path, ["item_number", "page", "is_sold", "price_eur"]), "price_eur").withColumn("is_sold", X.flag("is_sold")).withColumn("row_hash", X.row_hash("item_number"))
    known = rows.where("item_number % 4 = 0").select("row_hash")
    return X.new_rows(rows, known, "row_hash", F.col("page").cast("long")).select("item_number", "page", "is_sold", "price_eur")


def source_targeted_listings(spark, d):
    """Targeted listings: known by item, listing and market, or by hash where the listing has no number."""
    path = fresh_path(spark, "targeted")
    li = _t(spark, d, "lineitem").selectExpr("CAST(l_partkey AS STRING) AS inventory_uid", "CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE CAST(l_suppkey AS STRING) END AS item_id", "CASE WHEN l_linenumber % 2 = 0 THEN 'EBAY_DE' ELSE 'EBAY_US' END AS marketplace_id", "CAST(l_orderkey AS STRING) AS title")
    X.write_csv(li, path, 4)
    rows = X.read_strings(spark, path, ["inventory_uid", "item_id", "marketplace_id", "title"]).withColumn("row_hash", X.row_hash("inventory_uid", "item_id", "title", "marketplace_id"))
    keys = ["inventory_uid", "item_id", "marketplace_id"]
    known = rows.where("title % 5 = 0")
    seen = known.where("item_id <> ''").select(*keys).distinct()
    hashed = known.select("row_hash").distinct()
    numbered = rows.where("item_id <> ''").join(seen, keys, "left_anti")
    others = rows.where("item_id = ''").join(hashed, "row_hash", "left_anti")
    return latest_per_key(numbered.unionByName(others), keys, F.col("title").cast("long"), F.asc("row_hash")).select(*keys, "title")


def drop_folder_plan(spark, d):
    """Files of a drop folder: told apart by their headers, rejected, skipped by the ledger, or routed; hashes are those of the bytes."""
    path = fresh_path(spark, "drop")
    n = _t(spark, d, "nation")
    sold = n.select(F.col("n_nationkey").alias("Item_Number "), F.col("n_name").alias("title"), F.lit(1).alias("price_eur"), F.lit("2024-01-01").alias("sold_date_iso"), F.lit(1).alias("is_sold"))
    X.write_csv(sold, f"{path}/sold_new", 1)
    X.write_csv(sold.where("title < 'NATION_2'"), f"{path}/sold_known", 1)
    X.write_csv(sold.drop("title", "price_eur"), f"{path}/sold_short", 1)
    X.write_csv(n.select(F.lit(2).alias("avg_price_eur"), F.lit(3).alias("total_sold"), "n_name"), f"{path}/vcp_new", 1)
    X.write_csv(n, f"{path}/other", 1)
    known = X.hashes(spark, f"{path}/sold_known")
    ledger = known.select(F.lit("historical_ebay_sold").alias("source_type"), "hash", F.lit("success").alias("status")).unionByName(X.hashes(spark, f"{path}/vcp_new").select(F.lit("historical").alias("source_type"), "hash", F.lit("failed").alias("status")))
    plan = X.plan_drop_folder(spark, path, ledger)
    return plan.select(F.regexp_extract("path", r"/([^/]+)/[^/]*$", 1).alias("folder"), "source", F.array_join("missing", ",").alias("missing"), "action", (F.length("hash") == 64).alias("hashed"))


def ledger_skip_files(spark, d):
    """Days of events as files: each file's hash is taken from its bytes, files whose name and hash were read before are skipped."""
    path = fresh_path(spark, "ledger")
    e = _t(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    e.repartition("day").sortWithinPartitions("day", "event_id").write.partitionBy("day").option("header", True).csv(path)
    day = F.regexp_extract("path", r"day=([0-9-]+)/", 1)
    found = X.hashes(spark, path).withColumn("file", day)
    ledger = found.where("day(file) % 2 = 0").select("file", "hash")
    stale = found.where("day(file) % 5 = 1").select("file", F.lit("0").alias("hash"))  # same name, other bytes
    left = found.join(ledger.unionByName(stale), ["file", "hash"], "left_anti").select("file")
    counts = e.groupBy(F.col("day").alias("file")).agg(F.count("*").alias("n"))
    return left.join(counts, "file").select("file", "n")


def ledger_upsert(spark, d):
    """The ledger after a second reading: of a file's two entries the one with more rows inserted stays whole."""
    o = _t(spark, d, "orders")
    key = [F.col("o_orderpriority").alias("type"), F.date_format("o_orderdate", "yyyy-MM").alias("file")]
    entry = lambda status, batch: o.where(F.col("o_orderstatus") == status).groupBy(*key).agg(F.count("*").alias("n")).withColumns({"batch": F.lit(batch), "status": F.lit("success" if batch == "b1" else "partial")})
    both = entry("F", "b1").withColumn("no", F.lit(1)).unionByName(entry("O", "b2").withColumn("no", F.lit(0)))
    # a tie keeps what was there
    return both.groupBy("type", "file").agg(F.max_by(F.struct("n", "batch", "status"), F.struct("n", "no")).alias("x")).select("type", "file", "x.*")


def json_flatten(spark, d):
    """Nested JSON of listings as flat rows: values by path, the first that is there of several, lists joined by bars."""
    o = _t(spark, d, "orders")
    text = F.to_json(F.struct(
        F.col("o_orderkey").alias("itemId"),
        F.struct(F.round("o_totalprice", 2).alias("value"), F.lit("EUR").alias("currency")).alias("price"),
        F.when(F.col("o_custkey") % 2 == 0, F.struct(F.col("o_custkey").cast("string").alias("username"))).alias("seller"),
        F.array(F.struct(F.when(F.col("o_custkey") % 3 > 0, F.struct(F.lit(4.5).alias("value"))).alias("shippingCost"))).alias("shippingOptions"),
        F.array_compact(F.array(F.lit("FIXED_PRICE"), F.when(F.col("o_orderstatus") == "F", "BEST_OFFER"))).alias("buyingOptions"),
    ))
    x = F.from_json("text", "struct<itemId: long, price: struct<value: double, currency: string>, seller: struct<username: string, userId: string>, shippingOptions: array<struct<shippingCost: struct<value: double>>>, buyingOptions: array<string>>")
    y = o.select("o_custkey", text.alias("text")).withColumn("x", x)
    return y.select(F.col("x.itemId").alias("item_id"), F.col("x.price.value").alias("price"), F.col("x.price.currency").alias("currency"), F.coalesce("x.seller.userId", "x.seller.username").alias("seller"), F.get_json_object("text", "$.shippingOptions[0].shippingCost.value").cast("double").alias("shipping"), F.array_join("x.buyingOptions", "|").alias("options"))


def manifest_selection(spark, d):
    """Items of a manifest in its order, and what is wrong with it: repeated, unknown and ineligible items stop a run."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("uid"), (F.col("p_size") % 10 > 0).alias("eligible"))
    m = _t(spark, d, "lineitem").where("l_linenumber = 7").select((F.col("l_partkey") + F.when(F.col("l_suppkey") % 50 == 0, 100_000_000).otherwise(0)).alias("uid"), F.col("l_orderkey").alias("position"), "l_suppkey")
    x = m.join(p, "uid", "left").withColumn("again", F.count("*").over(Window.partitionBy("uid")) > 1)
    fault = F.when(F.col("eligible").isNull(), "NOT_FOUND").when(~F.col("eligible"), "INELIGIBLE").when(F.col("again"), "DUPLICATE").otherwise("OK")
    return x.select("position", "l_suppkey", "uid", fault.alias("fault"))


def table_counts(spark, d):
    """Rows and columns of each table, as the catalogue tools list them."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    out = None
    for name in names:
        t = _t(spark, d, name)
        one = t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(t.columns)).alias("cols"), F.lit(",".join(sorted(t.columns))).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def sink_versions(spark, d):
    """A table through its sinks: built, inserted into twice, upserted, updated from a join, cloned; rows carry what wrote them last."""
    c = _t(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("bal"), F.lit("built").alias("by"))
    t = S.Table(spark, fresh_path(spark, "table")).replace(c.where("c_custkey % 3 = 0"))
    more = c.where("c_custkey % 2 = 0").withColumn("by", F.lit("inserted"))
    t.insert_ignore(more, ["c_custkey"]).insert_ignore(more, ["c_custkey"])
    t.upsert(c.where("c_custkey % 5 = 0").withColumns({"bal": F.col("bal") + 1, "by": F.lit("upserted")}), ["c_custkey"])
    t.update_from(c.where("c_custkey % 7 = 0").withColumns({"bal": F.lit(0.0), "by": F.lit("updated")}), ["c_custkey"], ["bal", "by"])
    return t.clone(fresh_path(spark, "clone")).read()


def sink_scoped_overwrite(spark, d):
    """A folder of partitions of which those with new rows are replaced and all others stay."""
    path = fresh_path(spark, "scoped")
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", F.lit("old").alias("run"))
    S.overwrite_scope(c, path, "c_nationkey")
    S.overwrite_scope(c.where("c_nationkey % 4 = 0 AND c_custkey % 2 = 0").withColumn("run", F.lit("new")), path, "c_nationkey")
    return spark.read.parquet(path).select("c_custkey", "c_nationkey", "run")


def sink_reports(spark, d):
    """A report as CSV with quotes, commas and line ends in its cells, and a manifest as JSON; both read back."""
    path = fresh_path(spark, "report")
    r = _t(spark, d, "nation").select("n_nationkey", F.concat(F.lit('a "quoted", '), F.col("n_name"), F.lit(" ")).alias("text"))
    S.export_csv(r, f"{path}/csv")
    S.write_manifest(r.agg(F.count("*").alias("n"), F.lit(float("nan")).alias("bad"), F.sum("n_nationkey").alias("total")), f"{path}/json")
    rows = spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).schema("n_nationkey int, text string").csv(f"{path}/csv")
    one = spark.read.schema("n long, bad double, total long").json(f"{path}/json")
    return rows.crossJoin(F.broadcast(one)).select("n_nationkey", "text", "n", "bad", "total")  # one row


def paged_search(spark, d):
    """A search's answers by query, page by page: 50 listings a page, 7 pages and 320 listings at most."""
    path = fresh_path(spark, "answers").removeprefix("file://")
    s = _t(spark, d, "lineitem").where("l_linenumber = 1").select("l_returnflag", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    answers = {}
    for r in s.where("l_orderkey < 2000").collect():  # the fixture's answers, which a service would hold
        answers.setdefault(r["l_returnflag"], []).append(r["l_orderkey"])
    os.makedirs(path)
    for query, keys in answers.items():
        with open(f"{path}/{query}.jsonl", "w", encoding="utf-8") as f:
            f.writelines(json.dumps({"itemId": k, "no": i}) + "\n" for i, k in enumerate(keys))
    rows = paged.search(spark, path, sorted(answers), limit=50, pages=7, items=320)
    x = F.from_json("body", "itemId long, no long")
    return rows.select("query", "page", x.alias("x")).select("query", "page", F.col("x.itemId").alias("item_id"), F.col("x.no").alias("no"))


def bulk_inventory_upload(spark, d):
    """Rows of an upload against the inventory, by key: stock set, stock added, new, or refused; one refused row refuses all."""
    key = F.lower(F.concat_ws("|", "brand", "caliber", "part"))
    whole = F.trim("stock").rlike(r"^\d+$")
    old = cleaning.raw(spark, d).where("id % 2 = 0").where(whole).withColumn("key", key).groupBy("key").agg(F.sum(F.trim("stock").try_cast("long")).alias("held"))
    up = cleaning.raw(spark, d).where("id % 3 = 0").withColumn("key", key)
    w = Window.partitionBy("key").orderBy("id")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    sound = ~blank("brand") & ~blank("part")
    fault = F.when(~sound, "brand and part number are required").when(~F.coalesce(F.trim("stock").rlike(r"^[+-]?\d+$"), F.lit(False)), "stock must be a whole number").when(F.trim("stock").startswith("-"), "stock must be non-negative")
    x = up.withColumn("fault", fault).withColumn("nth", F.sum(F.when(F.col("fault").isNull(), 1).otherwise(0)).over(w))
    x = x.withColumn("fault", F.coalesce("fault", F.when(F.col("nth") > 1, "duplicate item in upload")))
    y = x.join(old, "key", "left")
    n = F.trim("stock").try_cast("long")
    return y.select("id", "fault", F.when(F.col("fault").isNull(), F.when(F.col("held").isNull(), "new").otherwise("update")).alias("action"), F.when(F.col("fault").isNull(), n).alias("stock_if_set"), F.when(F.col("fault").isNull(), n + F.coalesce("held", F.lit(0))).alias("stock_if_added"))


# ---------------------------------------------------------------- oracles
_RAW = cleaning._RAW
_LINES = "SELECT DISTINCT coalesce(brand, '') AS brand, coalesce(caliber, '') AS caliber, coalesce(part, '') AS part, coalesce(stock, '') AS stock FROM raw"
_BROAD = f"SELECT CAST(user_id % 300 AS VARCHAR) AS item_id, event_type AS title, TRY_CAST({_PRICE} AS DOUBLE) AS price_value, CAST(event_id % 4 AS DOUBLE) AS condition_id FROM events"
_UP_KEY = "lower(concat_ws('|', brand, caliber, part))"
QUERIES = {f.__name__: f for f in (csv_strings, source_inventory, source_broad_listings, source_aggregate_history, source_sold_listings, source_targeted_listings, drop_folder_plan, ledger_skip_files, ledger_upsert, json_flatten, manifest_selection, table_counts, sink_versions, sink_scoped_overwrite, sink_reports, paged_search, bulk_inventory_upload)}
ORACLE_SQL = {
    "csv_strings": "SELECT CAST(c_custkey AS VARCHAR) AS id, ' \"' || c_name || '\", ' AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS segment, '' AS none, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS folder FROM customer",
    "source_inventory": f"WITH {_RAW}, l AS ({_LINES}), h AS (SELECT *, sha256(brand || '||' || caliber || '||' || part || '||' || stock) AS row_hash FROM l) SELECT row_hash, brand, caliber, part, stock, row_number() OVER (ORDER BY row_hash) + 1000 AS id FROM h",
    "source_broad_listings": f"WITH r AS ({_BROAD}) SELECT item_id, title, price_value, min(condition_id) AS condition_id FROM r WHERE CAST(item_id AS INT) % 10 <> 3 GROUP BY 1, 2, 3",
    "source_aggregate_history": "SELECT CAST(p_partkey AS VARCHAR) AS title, p_size AS total_sold, CASE WHEN p_partkey % 5 < 3 THEN 'terapeak' ELSE 'page_' || p_size END AS source FROM part",
    "source_sold_listings": "SELECT CAST(o_custkey AS VARCHAR) AS item_number, CAST(o_orderkey AS VARCHAR) AS page, o_orderkey % 6 < 3 AS is_sold, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey AS DOUBLE) END AS price_eur FROM orders WHERE o_custkey % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    "source_targeted_listings": "WITH r AS (SELECT CAST(l_partkey AS VARCHAR) AS inventory_uid, CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS item_id, CASE WHEN l_linenumber % 2 = 0 THEN 'EBAY_DE' ELSE 'EBAY_US' END AS marketplace_id, l_orderkey AS o FROM lineitem), k AS (SELECT DISTINCT inventory_uid, item_id, marketplace_id FROM r WHERE o % 5 = 0 AND item_id <> '') SELECT inventory_uid, item_id, marketplace_id, CAST(min(o) AS VARCHAR) AS title FROM r LEFT JOIN k USING (inventory_uid, item_id, marketplace_id) WHERE CASE WHEN item_id = '' THEN o % 5 <> 0 ELSE (inventory_uid, item_id, marketplace_id) NOT IN (SELECT inventory_uid, item_id, marketplace_id FROM k) END GROUP BY 1, 2, 3",
    "drop_folder_plan": "SELECT * FROM (VALUES ('sold_new', 'ebay_sold', '', 'ROUTE', true), ('sold_known', 'ebay_sold', '', 'SKIP', true), ('sold_short', 'ebay_sold', 'price_eur,title', 'REJECT missing price_eur,title', true), ('vcp_new', 'vcp', '', 'ROUTE', true), ('other', NULL, NULL, 'REJECT unrecognized schema', true)) v(folder, source, missing, action, hashed)",
    "ledger_skip_files": "SELECT strftime(ts, '%Y-%m-%d') AS file, count(*) AS n FROM events GROUP BY 1 HAVING CAST(substr(file, 9, 2) AS INT) % 2 <> 0",
    "ledger_upsert": "WITH a AS (SELECT o_orderpriority AS type, strftime(o_orderdate, '%Y-%m') AS file, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1, 2) SELECT type, file, greatest(f, o) AS n, CASE WHEN o > f THEN 'b2' ELSE 'b1' END AS batch, CASE WHEN o > f THEN 'partial' ELSE 'success' END AS status FROM a WHERE f + o > 0",
    "json_flatten": "SELECT o_orderkey AS item_id, round(o_totalprice, 2) AS price, 'EUR' AS currency, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS seller, CASE WHEN o_custkey % 3 > 0 THEN 4.5 END AS shipping, CASE WHEN o_orderstatus = 'F' THEN 'FIXED_PRICE|BEST_OFFER' ELSE 'FIXED_PRICE' END AS options FROM orders",
    "manifest_selection": "WITH m AS (SELECT l_partkey + CASE WHEN l_suppkey % 50 = 0 THEN 100000000 ELSE 0 END AS uid, l_orderkey AS position, l_suppkey FROM lineitem WHERE l_linenumber = 7), c AS (SELECT uid, count(*) AS n FROM m GROUP BY 1) SELECT position, l_suppkey, uid, CASE WHEN p_partkey IS NULL THEN 'NOT_FOUND' WHEN p_size % 10 = 0 THEN 'INELIGIBLE' WHEN n > 1 THEN 'DUPLICATE' ELSE 'OK' END AS fault FROM m JOIN c USING (uid) LEFT JOIN part ON p_partkey = uid",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS rows, CAST(count(*) AS INT) AS cols, string_agg(column_name, ',' ORDER BY column_name) AS columns FROM (DESCRIBE {t})" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
    "sink_versions": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 5 = 0 THEN round(c_acctbal, 2) + 1 ELSE round(c_acctbal, 2) END AS bal, CASE WHEN c_custkey % 7 = 0 THEN 'updated' WHEN c_custkey % 5 = 0 THEN 'upserted' WHEN c_custkey % 3 = 0 THEN 'built' ELSE 'inserted' END AS by FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0 OR c_custkey % 5 = 0",
    "sink_scoped_overwrite": "WITH n AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey % 4 = 0 AND c_custkey % 2 = 0) SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey IN (SELECT * FROM n) THEN 'new' ELSE 'old' END AS run FROM customer WHERE c_nationkey NOT IN (SELECT * FROM n) OR c_custkey % 2 = 0",
    "sink_reports": "SELECT n_nationkey, 'a \"quoted\", ' || n_name || ' ' AS text, (SELECT count(*) FROM nation) AS n, CAST(NULL AS DOUBLE) AS bad, (SELECT CAST(sum(n_nationkey) AS BIGINT) FROM nation) AS total FROM nation",
    "paged_search": "WITH x AS (SELECT l_returnflag AS query, l_orderkey AS item_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity) - 1 AS no FROM lineitem WHERE l_linenumber = 1 AND l_orderkey < 2000) SELECT query, CAST(no // 50 AS INT) AS page, item_id, no FROM x WHERE no < 320",
    "bulk_inventory_upload": f"WITH {_RAW}, old AS (SELECT {_UP_KEY} AS key, CAST(sum(CAST(trim(stock) AS BIGINT)) AS BIGINT) AS held FROM raw WHERE id % 2 = 0 AND regexp_matches(trim(stock), '^\\d+$') GROUP BY 1), u AS (SELECT *, {_UP_KEY} AS key, CASE WHEN trim(coalesce(brand, '')) = '' OR trim(coalesce(part, '')) = '' THEN 'brand and part number are required' WHEN NOT coalesce(regexp_matches(trim(stock), '^[+-]?\\d+$'), false) THEN 'stock must be a whole number' WHEN starts_with(trim(stock), '-') THEN 'stock must be non-negative' END AS f FROM raw WHERE id % 3 = 0), "
    "x AS (SELECT *, coalesce(f, CASE WHEN sum(CASE WHEN f IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY id) > 1 THEN 'duplicate item in upload' END) AS fault FROM u) SELECT id, fault, CASE WHEN fault IS NULL THEN CASE WHEN held IS NULL THEN 'new' ELSE 'update' END END AS action, CASE WHEN fault IS NULL THEN CAST(trim(stock) AS BIGINT) END AS stock_if_set, CASE WHEN fault IS NULL THEN CAST(trim(stock) AS BIGINT) + coalesce(held, 0) END AS stock_if_added FROM x LEFT JOIN old USING (key)",
}

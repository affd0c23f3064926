"""The queries op1 to op10: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partlens.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partlens.llm.toxicity import severity

    return severity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partlens.llm.language_id import identify

    return identify(spark, table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partlens.llm.jaccard_join import jaccard_components

    return jaccard_components(spark, table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partlens.llm.decontaminate import contaminated

    # the distance of fingerprints is no result but how a pair was found
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hamming")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partlens.llm.suffix_dedup import remove_repeats

    return remove_repeats(spark, table(spark, sf_dir, "documents")).drop("kept")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partlens.llm.embedding_join import near_vectors

    return near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partlens.llm.warc import capture_history

    return capture_history(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partlens.llm.html_extract import main_text

    return main_text(spark, table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partlens.llm.packing import pack

    return pack(spark, table(spark, sf_dir, "documents"))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partlens.llm.token_file import round_trip

    return round_trip(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op3_language_id, op4_ngram_jaccard_join, op9_benchmark_decontamination, op2_suffix_array_dedup, op10_embedding_near_dedup, op5_warc, op6_html_extraction, op7_packing, op8_token_file)}
ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op2_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
        h AS (SELECT doc_id, s, md5(substr(x, 2 * s - 1, 800)) AS k FROM (SELECT doc_id, x, unnest(generate_series(1, n - 399)) AS s FROM d)),
        r AS (SELECT doc_id, s FROM h QUALIFY count(*) OVER (PARTITION BY k) > 1),
        i AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS b FROM r),
        j AS (SELECT doc_id, s, sum(b) OVER (PARTITION BY doc_id ORDER BY s) AS no FROM i),
        c AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS z FROM j GROUP BY doc_id, no),
        e AS (SELECT doc_id, a, z, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM c),
        t AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS z, string_agg(substr(x, 2 * y - 1, 2 * (a - y)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(z, 1) - 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
        n AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS k FROM g),
        c AS (SELECT k, min(doc_id) AS rep FROM n WHERE n > 0 GROUP BY 1),
        u AS (SELECT g.doc_id, n.n, unnest(s) AS h FROM g JOIN n USING (doc_id) JOIN c ON c.rep = g.doc_id),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        r(node, reach) AS (SELECT rep, rep FROM c UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
        m AS (SELECT node, min(reach) AS component FROM r GROUP BY 1)
        SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(rep, doc_id) AS set_id FROM n LEFT JOIN c ON c.k = n.k AND n.n > 0 LEFT JOIN m ON m.node = rep""",
    "op9_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
        i AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM b WHERE len(w) > 0),
        t AS (SELECT item_id, n, k, h, count(*) AS c FROM (SELECT item_id, n, k, unnest(list_transform(generate_series(1, n - k + 1), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS h FROM i) GROUP BY ALL),
        p AS (SELECT doc_id, k, len(w) - k + 1 AS m, unnest(generate_series(0, len(w) - k)) AS p, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS h
              FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
        x AS (SELECT doc_id, item_id, n, k, m, p, h, c FROM p JOIN t USING (k, h)),
        q AS (SELECT doc_id, item_id, n, k, m, min(p) - n + k AS lo, max(p) AS hi FROM x GROUP BY doc_id, item_id, n, k, m HAVING count(*) >= 0.75 * (n - k + 1)),
        y AS (SELECT doc_id, item_id, n, k, m, unnest(generate_series(lo, hi)) AS s FROM q),
        o AS (SELECT doc_id, item_id, n, k, m, s, h, least(count(*), any_value(c)) AS o FROM y JOIN x USING (doc_id, item_id, n, k, m) WHERE p BETWEEN s AND s + n - k GROUP BY ALL),
        z AS (SELECT doc_id, item_id, s, sum(o) AS o, least(s + n - k, m - 1) - greatest(s, 0) + 1 + n - k + 1 AS sizes FROM o GROUP BY doc_id, item_id, n, k, m, s)
        SELECT doc_id, item_id, greatest(s, 0) AS start_word, CAST(o AS DOUBLE) / (sizes - o) AS similarity FROM z WHERE o >= 0.75 * (sizes - o)
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(o AS DOUBLE) / (sizes - o) DESC, s) = 1""",
    "op10_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        r(node, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
        m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON node = vec_id LEFT JOIN n ON a = vec_id""",
}

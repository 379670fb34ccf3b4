"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm import hashtree, htmlcrf, langid, media, packing, simhash, spviterbi, topk, toxicity, urlrules
from locusflow.session import table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantize("embedding").alias("q"))
    return topk.topk_search(e, F.pmod("vec_id", F.lit(20)) == 0).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.read_media(media.to_media(table(spark, sf_dir, "documents")))
    tail = F.substring("payload", -16, 16)
    return got.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels come from the document that a page shows, whose id its path holds: blocked where it is toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = table(spark, sf_dir, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    shown = pages.select("url", F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[^?#]*?([0-9]+)', 1) as long)").alias("doc_id"))
    return urlrules.judge(pages, shown.join(bad, "doc_id").select("url", "bad"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcrf.extract(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashtree.assign(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by streaming Viterbi, and a digest of the text decoded from them, which is the document's again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = spviterbi.encode(docs)
    return spviterbi.decode(coded).select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"), F.length("text").cast("long").alias("decoded_chars"))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_media_columns, op3_toxicity, op4_url_filters, op5_simhash_dedup, op6_packing, op7_language_id, op8_html_extraction, op9_sharding, op10_sentencepiece)}

def _winner(key: str, node) -> str:
    """DuckDB expression of the shard that ``hashtree.place`` gives."""
    while len(node.children) == 1:
        node = node.children[0]
    if not node.children:
        return str(node.shard)
    draws = ", ".join(f"ln((CAST('0x' || substr(md5({key} || '|{c.name}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {float(c.weight)!r}" for c in node.children)
    return f"[{', '.join(_winner(key, c) for c in node.children)}][list_position([{draws}], list_max([{draws}]))]"


def _sharding_sql() -> str:
    """Placement, sizes, CRC-32 (bit by bit table, made by rule) and slots in plain SQL."""
    base, grown = (_winner("key", hashtree.topology(hashtree.SHARDS + more)) for more in (0, 1))
    return f"""
        WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
        d AS (
            SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size,
                   xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
            FROM documents, crc
        ),
        s AS (SELECT doc_id, size, text_crc32, {base} AS shard, {grown} AS grown_shard, CAST('0x' || substr(md5(key || '|' || CAST(size AS VARCHAR) || '|' || CAST(text_crc32 AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT GREATEST({hashtree.PARTS}, -(-COUNT(*) // {hashtree.SHARDS * hashtree.ROWS})) FROM documents) AS part FROM d)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM s
    """


ORACLE = {
    "op1_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
            FROM (SELECT DISTINCT vec_id, q FROM v) a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
        WHERE r <= 20
    """,
    "op4_url_filters": f"""
        WITH u AS (
            SELECT page_id, url, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
                   regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '(?s)#(.+)', 1) AS fragment
            FROM pages
        ),
        t AS (
            SELECT page_id, url, host, path, list_distinct(
                CASE WHEN scheme <> '' THEN ['scheme:' || scheme] ELSE [] END
                || list_transform(list_reverse(list_filter(string_split(host, '.'), lambda x: x <> '')), lambda x, i: 'host' || CAST(i - 1 AS VARCHAR) || ':' || x)
                || CASE WHEN regexp_extract(host, '([^.]+[.][^.]+)$', 1) <> '' THEN ['site:' || regexp_extract(host, '([^.]+[.][^.]+)$', 1)] ELSE [] END
                || list_transform(list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> ''), lambda x, i: 'path' || CAST(i - 1 AS VARCHAR) || ':' || x)
                || CASE WHEN regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1) <> '' THEN ['end:' || regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)] ELSE [] END
                || list_transform(list_filter(string_split_regex(query, '[&;]'), lambda x: x <> ''), lambda x: 'query:' || regexp_extract(x, '^([^=]*)', 1))
                || CASE WHEN fragment <> '' THEN ['fragment:' || fragment] ELSE [] END) AS tokens
            FROM u
        ),
        b AS (
            SELECT row_number() OVER () AS id, t.tokens, (l.toxic = 1 OR l.quality = 0) AS bad
            FROM t JOIN labels l ON TRY_CAST(regexp_extract(t.url, '://[^/?#]*/[^?#]*?([0-9]+)', 1) AS BIGINT) = l.doc_id
            WHERE (l.toxic = 1 OR l.quality = 0) IS NOT NULL AND len(t.tokens) > 0
        ),
        k AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE bad) AS bad, GREATEST({urlrules.LEAST}, CAST(ceil({urlrules.SUPPORT} * COUNT(*) - 1e-9) AS BIGINT)) AS need FROM b),
        x AS (SELECT id, bad, unnest(tokens) AS token FROM b),
        f AS (SELECT x.* FROM x JOIN (SELECT token FROM x GROUP BY 1 HAVING COUNT(*) FILTER (WHERE bad) >= (SELECT need FROM k)) USING (token)),
        c AS (
            SELECT [token] AS items, COUNT(*) AS m, COUNT(*) FILTER (WHERE bad) AS h FROM f GROUP BY ALL
            UNION ALL SELECT [a.token, b.token], COUNT(*), COUNT(*) FILTER (WHERE a.bad) FROM f a JOIN f b ON a.id = b.id AND a.token < b.token GROUP BY ALL
            UNION ALL SELECT [a.token, b.token, c.token], COUNT(*), COUNT(*) FILTER (WHERE a.bad) FROM f a JOIN f b ON a.id = b.id AND a.token < b.token JOIN f c ON a.id = c.id AND b.token < c.token GROUP BY ALL
        ),
        r AS (
            SELECT items FROM c, k
            WHERE h >= need AND h / m >= {urlrules.CONFIDENCE}
              AND (h * CAST(n AS DOUBLE) - m * CAST(bad AS DOUBLE)) ** 2 * n / GREATEST(m * CAST(n - m AS DOUBLE) * (CAST(bad AS DOUBLE) * (n - bad)), 1e-9) >= {urlrules.CHI2}
        ),
        v AS (
            SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, EXISTS (SELECT 1 FROM r WHERE list_has_all(t.tokens, r.items)) AS mined FROM t
        ),
        fits AS (
            SELECT *, list_filter([{", ".join(f"{{'text': '{r.text}', 'verdict': '{r.verdict}', 'host': '{r.host}', 'path': '{r.path}'}}" for r in sorted(urlrules.LISTED, key=lambda r: (-len(r.text), r.text)))}],
                   lambda x: (host = x.host OR ends_with(host, '.' || x.host)) AND starts_with(path, x.path))[1] AS fit FROM v
        )
        SELECT page_id, host, path, fit.text AS rule, coalesce(fit.verdict, CASE WHEN mined THEN 'block' ELSE 'allow' END) AS verdict, mined FROM fits
    """,
    "op9_sharding": _sharding_sql(),
}

"""Registered queries of this folder, each over its whole table with production parameters, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, credentials, langid, lm, minhash, mincut, mixing, records, runs, templates, turntree, urls, vectors
from .common import table

CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.linked_vectors(table(spark, folder, "embeddings"))


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return mincut.extracted(table(spark, folder, "pages"))


def op3_token_records(spark: SparkSession, folder: str) -> DataFrame:
    return records.token_records(table(spark, folder, "documents"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scored(table(spark, folder, "documents"))


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return urls.verdicts(pages, urls.listed_of(pages))


def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), width=4).drop("class")


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return templates.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn int, role string, text string")
    return chat.chat_digest(chat.conversation_records(rows.unionByName(extra))).drop("fingerprint")


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.languages(docs, langid.learned(docs))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turntree.rebuilt_trie(table(spark, folder, "conversations"))


def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return credentials.span_digest(credentials.secret_spans(docs, credentials.learned(docs)))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_digest(runs.periodic_runs(table(spark, folder, "documents"), runs.with_planted_period))


QUERIES = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_html_extraction, op3_token_records, op4_lm_scoring, op5_url_filters, op6_minhash_near_dedup,
    op7_source_mixing, op8_decontamination, op9_chat_formatting, op10_language_id, op11_conversation_trie, op12_secret_scan,
    op13_periodic_runs)}

_LABELS = ", ".join(f"'{x}'" for x in urls.JUNK_LABELS)
_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in urls.RULES)



def _crc32(text: str) -> str:
    """DuckDB has no crc32: bytes of an ASCII text one by one, eight shifts (marked -1) after each."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(4294967295, list_reduce({steps}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)"
            " WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT))")


ORACLE = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
            AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
        reach AS (SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT l.a, reach.r FROM reach JOIN links l ON l.b = reach.a),
        least AS (SELECT a, min(r) AS r FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, r AS component_id, vec_id = r AS kept
        FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op5_url_filters": f"""
        WITH rules AS (SELECT *, host || path AS rule FROM (VALUES {_RULES}) t(verdict, host, path)),
        u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        p AS (SELECT page_id,
          translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, row_number() OVER () AS i FROM u),
        c AS (SELECT *, host || regexp_replace(path, '/+$', '') AS canonical FROM p),
        listed AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), [{_LABELS}])),
        fits AS (
          SELECT i, arg_max(r.rule, (length(r.rule), r.rule)) AS rule, arg_max(r.verdict, (length(r.rule), r.rule)) AS verdict
          FROM c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path) GROUP BY i)
        SELECT page_id, host, path, rule, l.canonical IS NOT NULL AS listed,
          coalesce(verdict, CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM c LEFT JOIN fits USING (i) LEFT JOIN listed l USING (canonical)""",
    "op9_chat_formatting": f"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
        s AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said,
          length(replace(replace(text, '\\', '\\b'), '<|', '\\p'))
            + length(replace(replace(replace(role, '\\', '\\b'), '<|', '\\p'), chr(10), '\\n')) + 24 AS chars FROM t),
        g AS (SELECT conv_id, count(*) AS n_turns,
          string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS everything,
          string_agg(said, '' ORDER BY turn, role, text) AS loss, sum(chars)::BIGINT AS formatted_chars FROM s GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(everything) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
          formatted_chars FROM g""",
    "op11_conversation_trie": f"""
        WITH t AS (
          SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
          FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
        c AS (SELECT conv_id, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (
          SELECT c.conv_id, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h
          UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE pos < h),
        s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d FROM r),
        p AS (
          SELECT conv_id, d, text, list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY d) AS prefix FROM s
          UNION ALL SELECT conv_id, 0, '', [] FROM c),
        m AS (SELECT conv_id, d, text, min(conv_id) OVER (PARTITION BY prefix) AS node FROM p),
        n AS (SELECT node, d, count(*) AS n, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS own
          FROM m GROUP BY node, d),
        up AS (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.node AND m.d = n.d - 1),
        k AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM up GROUP BY ALL),
        below AS (
          SELECT m.node, m.d, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END) AS leaves, sum(n.own) AS saved
          FROM n LEFT JOIN k ON k.node = n.node AND k.d = n.d JOIN m ON m.conv_id = n.node AND m.d <= n.d GROUP BY m.node, m.d),
        l AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
        e AS (SELECT node, m.d, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) AS ids FROM l JOIN m USING (conv_id, d) GROUP BY node, m.d)
        SELECT up.node AS conv_id, up.d::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
          leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM up LEFT JOIN k USING (node, d) JOIN below USING (node, d) LEFT JOIN e USING (node, d)""",
    "op13_periodic_runs": f"""
        WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
          {_crc32("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents),
        e AS (SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS f FROM d),
        q AS (SELECT i, doc_id, n, CASE WHEN planted THEN list_transform(range(n),
          lambda x: w[1 + CASE WHEN x < a THEN x ELSE a + (x - a) % (1 + (n - a) // f) END]) ELSE w END AS w FROM e),
        x AS (SELECT i, n, unnest(range(n)) AS k, unnest(w) AS word FROM q),
        same AS (SELECT i, b.k - a.k AS p, a.k FROM x a JOIN x b USING (i, word) WHERE b.k > a.k AND 4 * (b.k - a.k) <= a.n),
        island AS (SELECT *, k - row_number() OVER (PARTITION BY i, p ORDER BY k) AS g FROM same),
        stretch AS (SELECT i, p, min(k) AS s, count(*) + p AS len FROM island GROUP BY i, p, g HAVING count(*) + p >= greatest(6, 4 * p)),
        run AS (SELECT i, s, len, min(p) AS p FROM stretch GROUP BY i, s, len),
        lines AS (SELECT i, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM run GROUP BY i),
        best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY i ORDER BY len DESC, s, p) = 1),
        kept AS (SELECT i, string_agg(word, ' ' ORDER BY k) AS kept FROM x
          WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.i = x.i AND x.k >= s + p AND x.k < s + len) GROUP BY i)
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, p::BIGINT AS period,
          (1000 * len // p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM q LEFT JOIN lines USING (i) LEFT JOIN best USING (i) LEFT JOIN kept USING (i)""",
}

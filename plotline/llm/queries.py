"""One query for each operator over its whole table; oracle SQL where SQL can say the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, lexical_search, line_dedup, ngram_join, prefix_trie, quality, quotes, secrets, substring_dedup, token_ids, warc
from .common import documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_ids.token_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 0)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir), 4, 85)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_ids": op2_token_ids,
    "op3_secret_scan": op3_secret_scan,
    "op4_ngram_join": op4_ngram_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_quote_links": op10_quote_links,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_warc": op13_warc,
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The table of CRC-32, from its polynomial.
_CRC = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)))"
#: Five hexadecimal digits of a SHA-1 are four digits of base 32.
_BASE32_SHA1 = "array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(html), 5 * i + 1, 5))::BIGINT >> s) & 31) + 1, 1)), '')), '')"

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_ASCII_LOWER} AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op11_prefix_trie": f"""
        WITH {_CRC},
             own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                            sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS turn, strlen(coalesce(text, '')) AS bytes
                     FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, conv_id - conv_id % 5 AS first,
                          xor(4294967295, list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % 9 AS h
                   FROM (SELECT DISTINCT conv_id FROM own), crc),
             r AS (SELECT c.conv_id, 0 AS part, pos, turn, bytes FROM c JOIN own ON own.conv_id = c.first AND pos <= h
                   UNION ALL SELECT c.conv_id, 1, pos, turn, bytes FROM c JOIN own ON own.conv_id = c.conv_id AND pos > h),
             s AS (SELECT conv_id, coalesce(turns, []) AS turns, coalesce(sizes, []) AS sizes
                   FROM c LEFT JOIN (SELECT conv_id, list(turn ORDER BY part, pos) AS turns, list(bytes ORDER BY part, pos) AS sizes FROM r GROUP BY conv_id) USING (conv_id)),
             b AS (SELECT conv_id, turns, sizes, unnest(range(len(turns) + 1)) AS depth FROM s),
             n AS (SELECT depth, turns[1:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(sizes[depth]), 0) AS bytes,
                          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
                   FROM b GROUP BY ALL),
             k AS (SELECT depth - 1 AS depth, node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
             m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, node)),
             u AS (SELECT up AS depth, node[1:up] AS node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
                   FROM (SELECT *, unnest(range(depth + 1)) AS up FROM m) GROUP BY ALL)
        SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
        FROM m JOIN u USING (depth, node) LEFT JOIN n p ON p.depth = m.depth - 1 AND p.node = m.node[1:m.depth - 1]
    """,
    "op13_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             g AS (SELECT html, max(page_id) AS keep FROM p GROUP BY html)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32_SHA1} AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM p JOIN g USING (html)
    """,
    "op12_lexical_search": rf"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_ASCII_LOWER}, '{lexical_search.TERM}')) AS term FROM documents),
             l AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
             s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM l),
             tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
             w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, docs),
             m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM l, s),
             q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_ASCII_LOWER}, '{lexical_search.TERM}')) AS term FROM benchmark),
             r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
                   FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
             o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
    """,
}

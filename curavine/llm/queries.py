"""The queries of this subpackage: each operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, html_text, language, lexical_search, lm, packing, pieces, prefix_trie, secret_scan, token_counts
from . import embedding_dedup as embed
from . import exact_dedup as exact
from . import near_dedup as near


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_dedup(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, the secrets of the combined automaton's rules: numbers and digest of the base kinds, and all spans."""
    return secret_scan.digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each item of benchmark, scores added up by one owner of terms after another."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, from a ternary search tree for each range shard."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


#: Patterns of secrets as SQL has them: kind, whole match, the group that has a least length, that length.
_SECRETS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", "(AKIA[A-Z0-9]+)", 18), ("hex", "([0-9a-f]+)", 16), ("github", "gh[pousr]_([A-Za-z0-9]+)", 36), ("slack", "xox[abprs]-([A-Za-z0-9-]+)", 10),
    ("jwt", r"(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 36), ("private_key", "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 0),
]


def _secrets_sql() -> str:
    """A match's place follows from the lengths of the matches, and of the gaps before them, up to it."""
    one = "SELECT rid, {k} AS k, '{kind}' AS kind, unnest(regexp_extract_all(t, '{all}', 1)) AS gap, unnest(regexp_extract_all(t, '{all}', 2)) AS hit, unnest(regexp_extract_all(t, '{all}', 3)) AS own, {least} AS least, unnest(range(len(regexp_extract_all(t, '{all}', 1)))) AS i FROM d"
    each = " UNION ALL ".join(one.format(k=k, kind=kind, all=f"(?s)(.*?)({pattern})", least=least) for k, (kind, pattern, least) in enumerate(_SECRETS))
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid, k ORDER BY i) AS BIGINT) AS upto FROM ({each})),
        s AS (SELECT rid, k, kind, upto - length(hit) AS pos, kind || ':' || (upto - length(hit)) || ':' || upto AS span FROM m WHERE length(own) >= least),
        g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                     string_agg(span, ',' ORDER BY pos, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY pos, k) AS spans FROM s GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (rid)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
                  FROM documents)
            WINDOW w AS (PARTITION BY t)""",
        "op9_chat_format": """
            WITH m AS (
                SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                       CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
                       CASE role WHEN 'user' THEN 'turn ' || conv_id || '.' || turn
                                 WHEN 'assistant' THEN 'turn ' || conv_id || '.' || (turn - 1) END AS id
                FROM conversations),
            n AS (SELECT conv_id, id, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'result') AS results
                  FROM m WHERE id IS NOT NULL AND conv_id IS NOT NULL GROUP BY ALL),
            s AS (SELECT m.*, CASE WHEN kind = 'message' THEN 'plain' WHEN calls > 1 OR results > 1 THEN 'ambiguous'
                                   WHEN kind = 'call' THEN CASE WHEN results = 1 THEN 'answered' ELSE 'open' END
                                   WHEN calls = 1 THEN 'linked' ELSE 'orphan' END AS status
                  FROM m LEFT JOIN n USING (conv_id, id))
            SELECT conv_id, turn, turn AS order_turn, 0 AS order_step, 0 AS order_depth, kind, id, status,
                   kind <> 'call' OR length(text) >= 1 AS valid,
                   CASE WHEN kind = 'call' AND length(text) < 1 THEN 'prompt: too short' ELSE '' END AS problems,
                   '{' || CASE WHEN kind = 'call' THEN '"arguments":{"prompt":' || to_json(text) || '},' ELSE '"content":' || to_json(text) || ',' END
                   || '"conversation":' || conv_id || CASE WHEN id IS NULL THEN '' ELSE ',"id":' || to_json(id) END
                   || ',"kind":"' || kind || '"' || CASE WHEN kind = 'call' THEN ',"name":"respond"' ELSE '' END
                   || ',"role":' || to_json(role) || ',"status":"' || status || '","turn":' || turn || '}' AS json
            FROM s""",
        "op11_secret_scan": _secrets_sql(),
        # the CRC-32 is worked out bit by bit; a prefix is named by the digests of its turns, 64 characters each
        "op13_prefix_trie": r"""
            WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i
                       FROM (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
                                    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
            c AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                             lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))) % 4 AS h
                  FROM (SELECT DISTINCT conv_id FROM o)),
            b AS (SELECT c.conv_id, 0 AS part, i, k, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND i <= h
                  UNION ALL SELECT c.conv_id, 1, i, k, words FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
            s AS (SELECT conv_id, words, row_number() OVER w AS depth, string_agg(k, '') OVER w AS name FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
            e AS (SELECT c.conv_id, count(depth) AS turns FROM c LEFT JOIN s USING (conv_id) GROUP BY 1),
            m AS (SELECT conv_id, words, depth, name FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
            n AS (SELECT name, depth, min(conv_id) AS low, count(*) AS n, any_value(words) AS words,
                         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends FROM m JOIN e USING (conv_id) GROUP BY 1, 2),
            k AS (SELECT left(name, length(name) - 64) AS name, count(*) AS kids FROM n WHERE depth > 0 GROUP BY 1),
            l AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (name)),
            t AS (SELECT left(name, 64 * a) AS name, count(*) FILTER (kids = 0) AS leaves, CAST(sum((n - 1) * words) AS BIGINT) AS saved
                  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM l) GROUP BY 1)
            SELECT l.low AS conv_id, l.depth AS depth, p.low AS parent_conv_id, l.n AS n_convs, kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, l.ends AS ends_sha256
            FROM l JOIN t USING (name) LEFT JOIN n p ON l.depth > 0 AND p.name = left(l.name, length(l.name) - 64)""",
        "op12_lexical_search": r"""
            WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{t}') AS w FROM documents),
            s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
            p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
            f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p, s GROUP BY term, docs),
            b AS (SELECT iid, item_id, term, count(*) AS times
                  FROM (SELECT row_number() OVER () AS iid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{t}')) AS term FROM benchmark) GROUP BY ALL),
            r AS (SELECT iid, item_id, rid, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
                  FROM b JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL)
            SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id, rid) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 20""".replace("{t}", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"),
    }

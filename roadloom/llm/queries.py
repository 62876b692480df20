"""The queries of this subpackage: each operator over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadloom.llm import bpe, chunk_prints, conversations, decontamination, hard_negatives, line_quality, near_duplicates, ranked_search, sharding, token_records, toxicity, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register("op1_decontamination", """
    WITH doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
         item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
         placed AS (SELECT item_id, words, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i
                    FROM item WHERE len(words) > 0),
         win AS (SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS w FROM placed),
         lengths AS (SELECT DISTINCT n FROM win),
         spot AS (SELECT r, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM doc, lengths WHERE len(words) >= n),
         seen AS (SELECT r, i, spot.n, item_id FROM spot JOIN win ON win.n = spot.n AND w = array_to_string(words[i : i + spot.n - 1], ' ')),
         hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM seen) GROUP BY r),
         found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
                   FROM seen GROUP BY r)
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM doc LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
""")
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents hold benchmark passages, and how much of each."""
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op2_chat", """
    WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
         placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
                    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM turns),
         prefixes AS (SELECT conv_id, place, n_turns, list(row(role, text)) OVER (PARTITION BY conv_id ORDER BY place) AS said FROM placed),
         ends AS (SELECT said, n_turns, min(conv_id) AS conv_id, count(*) AS n_equal FROM prefixes WHERE place = n_turns GROUP BY ALL),
         kept AS (SELECT * FROM ends WHERE said NOT IN (SELECT said FROM prefixes WHERE place < n_turns))
    SELECT conv_id, ((place - 1) // 1024)::INT AS piece, kept.n_turns, n_equal,
           string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
    FROM kept JOIN placed USING (conv_id) GROUP BY ALL
""")
def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations that no longer one begins with, rendered."""
    return conversations.formatted(table(spark, folder, "conversations"))


# The checksum goes over the bytes with a table of 256 remainders, made by its rule.
@register("op3_sharding", """
    WITH RECURSIVE step AS (SELECT range AS b, range AS c, 0 AS k FROM range(256)
            UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
         remainders AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
         sized AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, coalesce(text, '') AS text FROM documents),
         summed AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS start, sum(size) OVER () AS total FROM sized),
         cut AS (SELECT *, (((2 * start + size) * 24) // (2 * total))::INT AS shard FROM summed)
    SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
               lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
           'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
    FROM cut, remainders
""")
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The shard and slot of each document, shards of near equal bytes."""
    return sharding.assignment(table(spark, folder, "documents"))


@register("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they are."""
    return chunk_prints.compare_with_edits(table(spark, folder, "documents"))


#: Host, beginning of the path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@register("op5_url_filter", """
    WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
            ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
         parts AS (SELECT row_number() OVER () AS r, page_id, url,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
         best AS (SELECT r, max(struct_pack(n := length(rules.host || rules.path), rule := rules.host || rules.path, verdict := verdict)) AS b
            FROM parts JOIN rules ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host)) AND starts_with(parts.path, rules.path)
            GROUP BY r)
    SELECT page_id, url, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)
""")
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, deciding rule and verdict of each page."""
    return url_filter.judge(table(spark, folder, "pages"), url_filter.rules_table(spark, URL_RULES))


@register("op6_warc", """
    WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, upper(sha1(coalesce(html, ''))) AS h FROM pages),
         named AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32),
            lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
            row_number() OVER (PARTITION BY payload ORDER BY page_id) AS place, first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id) AS first
            FROM hashed)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN place > 1 THEN first END AS refers_to FROM named
""")
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """What the archives of all pages say of each page."""
    return warc.archive_and_read(table(spark, folder, "pages"))


@register("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score and prediction for each document."""
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The group of near duplicates of each document, and its number of links."""
    return near_duplicates.report(table(spark, folder, "documents"))


@register("op9_bpe")
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens of each document, as digests of the ids and of the decoded text."""
    return bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@register("op10_quality")
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """A quality score and prediction for each document."""
    return line_quality.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op11_ranked_search", """
    WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
         item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
         total AS (SELECT count(*) AS N, sum(len(words))::BIGINT AS L FROM doc WHERE len(words) > 0),
         tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(words) AS t FROM doc) WHERE t IN (SELECT t FROM item) GROUP BY r, t),
         weight AS (SELECT t, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, N),
         part AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(words) * N) // L))) AS s
                  FROM tf JOIN weight USING (t) JOIN doc USING (r), total),
         scored AS (SELECT item_id, r, sum(s)::BIGINT AS score FROM item JOIN part USING (t) GROUP BY item_id, r HAVING score > 0)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
    FROM scored JOIN doc USING (r) QUALIFY rank <= 10
""")
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that match each benchmark item best."""
    return ranked_search.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op12_token_records")
def op12_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """What the record files of all documents' token ids say of each document."""
    return token_records.report(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op13_hard_negatives", """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score
               FROM v AS a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
         p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
               QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
""")
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives for every hundredth vector and each of its nearest rows of the same label."""
    return hard_negatives.report(table(spark, folder, "embeddings"))

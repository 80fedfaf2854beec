"""The registered queries of this subpackage and their SQL."""
from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from vacancia.plans.registry import Query, Registry

llm = Registry()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP6_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text,
             list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)),
                         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
      FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM g),
again AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n
            FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
s AS (SELECT w.doc_id, text, len(w)::BIGINT AS n_words,
             length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters,
             length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS uppers,
             length(text) - length(replace(text, '!', '')) AS exclaims
      FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words
            OR 10 * n_symbols > n_words OR 2 * letters < word_chars OR 2 * uppers > letters
            OR 10 * exclaims > 3 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
FROM r
"""

# Levels as lists per source; crc32 bit by bit over the bytes of the decimal id.
OP11_SQL = r"""
WITH RECURSIVE v AS (
    SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-')
              || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
              || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
           xor(list_reduce(
               list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                   lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
               lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 5 = 0 AS tampered
    FROM documents),
d AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             sha256(head || CASE WHEN coalesce(tampered, false) THEN coalesce(strlen(low) || ':' || low, '-')
                                 ELSE coalesce(strlen(text) || ':' || text, '-') END) AS given
      FROM v),
n AS (SELECT *, row_number() OVER () AS id,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
lv AS (SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM n GROUP BY source
       UNION ALL
       SELECT source, level + 1, list_transform(range(0, (len(nodes) + 15) // 16),
              lambda i: sha256(array_to_string(nodes[16 * i + 1:16 * i + 16], ''))) FROM lv WHERE len(nodes) > 1),
so AS (SELECT source, nodes[1] AS subroot, level AS height,
              row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM lv WHERE len(nodes) = 1),
up AS (SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM so
       UNION ALL
       SELECT level + 1, list_transform(range(0, (len(nodes) + 15) // 16),
              lambda i: sha256(array_to_string(nodes[16 * i + 1:16 * i + 16], ''))) FROM up WHERE len(nodes) > 1),
st AS (SELECT n.id, lv.level AS k, n.pos // (16 ** lv.level)::BIGINT AS ix, lv.nodes
       FROM n JOIN lv ON n.source IS NOT DISTINCT FROM lv.source WHERE len(lv.nodes) > 1
       UNION ALL
       SELECT n.id, so.height + up.level, so.pos // (16 ** up.level)::BIGINT, up.nodes
       FROM n JOIN so ON n.source IS NOT DISTINCT FROM so.source CROSS JOIN up WHERE len(up.nodes) > 1),
pr AS (SELECT id, list(array_to_string(nodes[ix // 16 * 16 + 1:ix], '') ORDER BY k) AS l,
              list(array_to_string(nodes[ix + 2:ix // 16 * 16 + 16], '') ORDER BY k) AS r
       FROM st GROUP BY id),
fo AS (SELECT n.id, 0 AS k, n.given AS digest, coalesce(l, []) AS l, coalesce(r, []) AS r
       FROM n LEFT JOIN pr ON n.id = pr.id
       UNION ALL
       SELECT id, k + 1, sha256(l[k + 1] || digest || r[k + 1]), l, r FROM fo WHERE k < len(l))
SELECT n.doc_id, n.leaf, so.subroot, up.nodes[1] AS root,
       sha256(array_to_string(list_transform(range(1, len(fo.l) + 1), lambda i: fo.l[i] || fo.r[i]), '')) AS proof_sha256,
       fo.digest AS folded_root, fo.digest = up.nodes[1] AS verified
FROM n JOIN fo ON n.id = fo.id AND fo.k = len(fo.l) JOIN so ON n.source IS NOT DISTINCT FROM so.source
     JOIN up ON len(up.nodes) = 1
"""


# Every order is walked over the counts of the 32 failure sets; Shapley sums by adding up the steps.
OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text,
             list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             min(doc_id) OVER (PARTITION BY text) AS first
      FROM t),
f AS (SELECT doc_id, part,
             list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
                 WHEN 'A' THEN len(w) < 200
                 WHEN 'B' THEN 100 * len(list_distinct(w)) < 50 * len(w)
                 WHEN 'C' THEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text)
                 WHEN 'D' THEN regexp_matches(text, '[#$%&*|]')
                 ELSE coalesce(first < doc_id, false) END) AS failed
      FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
      FROM labels GROUP BY doc_id),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
      FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, failed),
o AS (SELECT '' AS filter_order
      UNION ALL
      SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)
      WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier
      FROM o, (SELECT unnest(range(1, 6))::INT AS step) WHERE length(filter_order) = 5),
r AS (SELECT part, filter_order, step, letter,
             list_contains(failed, letter) AS hit,
             len(list_filter(failed, lambda x: contains(earlier, x))) > 0 AS gone,
             failed = [letter] AS alone, n, good, toxic
      FROM c, s),
a AS (SELECT part, filter_order, step, letter,
             sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM r GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM a
"""


# Square in the vectors, as a join of all pairs: for the small tables of a test.
OP13_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                             AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                        THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e
    FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS to_id FROM v
      UNION
      SELECT r.vec_id, l.b FROM r JOIN l ON r.to_id = l.a),
c AS (SELECT vec_id, min(to_id) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.a
"""


@llm.add("op1_warc_round_trip", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archives that it was written to."""
    from vacancia.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


@llm.add("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: fixed patterns and random-looking runs."""
    from vacancia.llm.secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


@llm.add("op3_packed_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest, from the packed files that it was written to."""
    import public_tokenizers

    from vacancia.llm.tokenfile import token_file_round_trip

    return token_file_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                                 vocabulary=49_408, end_id=2)


@llm.add("op4_scaled_sketches")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch, that of its edited text, and their likeness."""
    from vacancia.llm.fingerprints import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


@llm.add("op5_pfair_mix")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's blocks and slots in the mix, with their windows."""
    from vacancia.llm.mixing import schedule

    return schedule(table(spark, sf_dir, "documents"))


@llm.add("op6_quality_cascade", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's word statistics and the cascade's verdict."""
    from vacancia.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


@llm.add("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and decoded bytes, as digests."""
    import public_tokenizers

    from vacancia.llm.bpe import encoding_digests

    return encoding_digests(table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@llm.add("op8_simhash_components")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the smallest id it is linked to."""
    from vacancia.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@llm.add("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    from vacancia.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@llm.add("op10_paragraph_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs that repeat across documents, with the document whose copy stays."""
    from vacancia.llm.paragraphs import repeated_paragraphs

    return repeated_paragraphs(table(spark, sf_dir, "documents"))


@llm.add("op11_merkle_manifest", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the manifest, and the check of a partly tampered table."""
    from vacancia.llm.merkle import manifest_report

    return manifest_report(table(spark, sf_dir, "documents"))


@llm.add("op12_filter_interaction", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of every order, and its Shapley sum."""
    from vacancia.llm.interaction import interaction_report

    return interaction_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@llm.add("op13_cover_tree_links", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and the smallest id that it is linked to."""
    from vacancia.llm.cover import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"))


def _pipeline():
    return importlib.import_module("corpus_pipeline")


@llm.add("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    return _pipeline().run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(llm.queries)


def oracle_sql() -> dict[str, str]:
    return dict(llm.oracles)

"""The registered queries of the training-data operators and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.ngram_join import link_documents
    return link_documents(table(spark, sf_dir, "documents"))


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.sharding import shard_documents
    return shard_documents(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (
  SELECT vec_id AS node, vec_id AS reached FROM embeddings
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a)
SELECT node AS vec_id, (SELECT count(*) FROM l WHERE l.a = node)::BIGINT AS n_links, min(reached) AS component_id,
       node = min(reached) AS kept
FROM r GROUP BY node
"""


@query("op3_embedding_dedup", OP3_SQL)
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.embedding_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, octet_length(raw) AS n, sha256(raw) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@query("op4_warc", OP4_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.warc import round_trip
    return round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH v AS (SELECT source, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line_key
  FROM documents WHERE text IS NOT NULL),
b AS (SELECT line_key FROM v WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT source) >= 10),
l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
m AS (SELECT l.*, b.line_key IS NOT NULL AS cut FROM l LEFT JOIN b ON b.line_key = trim(line, ' ' || chr(9) || chr(13)))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(cut::INT)::BIGINT AS n_removed, false AS left_whole,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS text
FROM m GROUP BY doc_id, m.text
UNION ALL
SELECT doc_id, 0, 0, false, NULL FROM documents WHERE text IS NULL
"""


@query("op5_line_dedup", OP5_SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.line_dedup import dedup_lines
    return dedup_lines(table(spark, sf_dir, "documents"), keep_copies=False).select("doc_id", "line_report.*", "text")


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.packing import pack
    return pack(table(spark, sf_dir, "documents")).drop("ids")


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.word_bpe import round_trip
    return round_trip(table(spark, sf_dir, "documents"))


@query("op8_ann")
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.ann import nearest_neighbours
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.langid import identify
    return identify(table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS grp, doc_id::VARCHAR AS d, text,
         coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-')
         || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS mid,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
           lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a // 2, 3988292384 * (a % 2)) END) AS crc
  FROM documents),
s AS (
  SELECT doc_id, grp, sha256(coalesce(strlen(d)::VARCHAR || ':' || d, '-') || mid || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 5 = 0
              THEN sha256(coalesce(strlen(d)::VARCHAR || ':' || d, '-') || mid || coalesce(strlen(low)::VARCHAR || ':' || low, '-')) END AS changed
  FROM t),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM s),
n AS (
  SELECT grp, 0 AS level, i, leaf AS digest, count(*) OVER (PARTITION BY grp) AS k FROM l
  UNION ALL
  SELECT grp, level, i, digest, count(*) OVER (PARTITION BY grp) FROM (
    SELECT grp, level + 1 AS level, i // 16 AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest
    FROM n WHERE k > 1 GROUP BY grp, level, i // 16)),
r AS (SELECT grp, digest AS subroot, level AS height, row_number() OVER (ORDER BY grp) - 1 AS i FROM n WHERE k = 1),
u AS (
  SELECT 0 AS level, i, subroot AS digest, count(*) OVER () AS k FROM r
  UNION ALL
  SELECT level, i, digest, count(*) OVER () FROM (
    SELECT level + 1 AS level, i // 16 AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM u WHERE k > 1 GROUP BY level, i // 16)),
f AS (
  SELECT l.doc_id, l.grp, l.i AS id, l.leaf, r.subroot, r.height, r.i AS ri, 0 AS level, l.i AS i, coalesce(l.changed, l.leaf) AS node, '' AS proof
  FROM l JOIN r USING (grp)
  UNION ALL
  SELECT doc_id, grp, id, leaf, subroot, height, ri, level + 1, CASE WHEN level + 1 = height THEN ri ELSE i // 16 END,
         sha256(string_agg(CASE WHEN b_i = i THEN node ELSE digest END, '' ORDER BY b_i)),
         proof || coalesce(string_agg(digest, '' ORDER BY b_i) FILTER (b_i <> i), '')
  FROM (
    SELECT f.*, b.i AS b_i, b.digest FROM f JOIN n b ON b.grp = f.grp AND b.level = f.level AND b.i // 16 = f.i // 16 WHERE f.level < f.height
    UNION ALL
    SELECT g.*, b.i AS b_i, b.digest FROM f g JOIN u b ON b.level = g.level - g.height AND b.i // 16 = g.i // 16 WHERE g.level >= g.height AND b.k > 1)
  GROUP BY doc_id, grp, id, leaf, subroot, height, ri, level, i, node, proof),
w AS (SELECT digest AS root, level FROM u WHERE k = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM f, w WHERE f.level = f.height + w.level
"""


@query("op12_merkle", OP12_SQL)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.merkle import verify_documents
    return verify_documents(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
k AS (SELECT unnest(range(1, 6)) AS k),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, k WHERE len(w) >= k),
f AS (SELECT lang, phrase, k, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (
  SELECT c.lang, c.phrase, c.k, a, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000 * a * n) // (x.f * y.f), cut) AS place
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:c.k], ' ') JOIN n ON n.lang = c.lang),
d AS (
  SELECT * FROM s WHERE place = 1 AND NOT EXISTS (
    SELECT 1 FROM f q WHERE q.lang = s.lang AND q.k > s.k AND 100 * q.f >= 100 * s.a AND contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' '))),
e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM e WHERE rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents"))


@query("op13_pii")  # offsets of matches, and the transducers, are beyond SQL: see tests/llm/test_pii.py
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.pii import personal_data, report
    return report(personal_data(table(spark, sf_dir, "documents")))

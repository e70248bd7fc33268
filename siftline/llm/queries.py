"""The operators as named queries over the given tables, with their check SQL where SQL can state the result."""
from . import (
    block_labeller, cuckoo_dedup, decontaminate, infill, language_id, license_index, ngram_join, one_bit_search, packed_ids, sanitise, source_mix, warc,
    whitening,
)
from .common import read_table

QUERIES, CHECK_SQL = {}, {}


def query(name, sql=None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            CHECK_SQL[name] = sql
        return build

    return add


@query("op1_license_index")
def op1(spark, folder):
    return license_index.scan(read_table(spark, folder, "documents"))


@query("op2_block_labeller")
def op2(spark, folder):
    return block_labeller.main_texts(read_table(spark, folder, "pages"))


@query("op3_source_mix", r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS stop,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT 0 AS step, 0.0::DOUBLE AS level
  UNION ALL
  SELECT step + 1, ((SELECT sum(source_size)::DOUBLE FROM sources) - (SELECT coalesce(sum(stop), 0)::DOUBLE FROM sources WHERE weight * level > stop))
    / (SELECT sum(weight) FROM sources WHERE weight * level <= stop)
  FROM levels WHERE step < 60),
targets AS (
  SELECT source, source_size, least(weight * (SELECT max(level) FROM levels), stop::DOUBLE) AS target FROM sources),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats,
    target - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS remainder
  FROM targets),
runs AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY hash RANGE UNBOUNDED PRECEDING)::BIGINT AS upto,
    sum(size) OVER (PARTITION BY source, hash)::BIGINT AS words
  FROM sized)
SELECT doc_id, size, source_size, target,
  size * (repeats + CASE WHEN remainder > 0 AND 2 * (upto - words) + words <= 2 * remainder THEN 1 ELSE 0 END) AS taken
FROM runs JOIN parts ON runs.source IS NOT DISTINCT FROM parts.source
""")
def op3(spark, folder):
    return source_mix.mix(read_table(spark, folder, "documents")).drop("repeats")


@query("op4_decontaminate", r"""
WITH items AS (
  SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
placed AS (SELECT item_id, n, k, unnest(range(0, n - k + 1)) AS o, array_to_string(w[o + 1:o + k], ' ') AS s FROM items),
weights AS (SELECT s, ln(1 + (SELECT count(*) FROM items)::DOUBLE / count(DISTINCT item_id)) AS weight FROM placed GROUP BY s),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
runs AS (
  SELECT doc_id, k, len(w) AS size, unnest(range(0, len(w) - k + 1)) AS p, array_to_string(w[p + 1:p + k], ' ') AS s
  FROM docs, (SELECT DISTINCT k FROM items) WHERE len(w) >= k),
windows AS (
  SELECT DISTINCT doc_id, k, greatest(0, least(p - o, size - n)) AS start, n FROM runs JOIN (SELECT DISTINCT s, k, o, n FROM placed) USING (s, k)),
held AS (
  SELECT windows.doc_id, k, start, n, s, count(*) AS c FROM windows JOIN runs USING (doc_id, k) WHERE p >= start AND p <= start + n - k GROUP BY ALL),
weighed AS (SELECT held.*, coalesce(weight, ln(1 + (SELECT count(*) FROM items)::DOUBLE)) AS weight FROM held LEFT JOIN weights USING (s)),
counted AS (SELECT item_id, n, s, count(*) AS m FROM placed GROUP BY item_id, n, s),
totals AS (SELECT doc_id, start, n, sum(c * weight) AS w FROM weighed GROUP BY ALL),
item_totals AS (SELECT item_id, sum(m * weight) AS v FROM counted JOIN weights USING (s) GROUP BY item_id),
shared AS (
  SELECT doc_id, start, n, item_id, sum(least(c, m) * weight) AS joint FROM weighed JOIN counted USING (s, n) GROUP BY doc_id, start, n, item_id)
SELECT doc_id, item_id, max(round(joint / (w + v - joint), 6)) AS similarity
FROM shared JOIN totals USING (doc_id, start, n) JOIN item_totals USING (item_id)
GROUP BY doc_id, item_id HAVING max(round(joint / (w + v - joint), 6)) >= 0.8
""")
def op4(spark, folder):
    return decontaminate.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query("op5_warc", """
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM (
  SELECT page_id, html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last,
    list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(sha1(coalesce(html, '')), 10 * (k // 8) + 1, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) % 32)::INT, 1)
      FOR k IN range(32)], 'string_agg', '') AS digest
  FROM pages)
""")
def op5(spark, folder):
    return warc.archived(read_table(spark, folder, "pages"), min_bytes=0)


@query("op6_language_id")
def op6(spark, folder):
    return language_id.identify(read_table(spark, folder, "documents"))


@query("op7_cuckoo_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
""")
def op7(spark, folder):
    return cuckoo_dedup.exact_groups(read_table(spark, folder, "documents"))


@query("op8_ngram_join", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
often AS (SELECT t FROM tokens GROUP BY t HAVING count(*) > 1),
shared AS (SELECT tokens.* FROM tokens JOIN often USING (t)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, least(min(reach.b), sets.doc_id) AS component_id
FROM sets JOIN reach ON reach.a = sets.doc_id GROUP BY sets.doc_id, s
""")
def op8(spark, folder):
    return ngram_join.near_duplicates(read_table(spark, folder, "documents"))


@query("op9_packed_ids")
def op9(spark, folder):
    return packed_ids.packed_tokens(read_table(spark, folder, "documents"))


@query("op10_sanitise")
def op10(spark, folder):
    return sanitise.report(read_table(spark, folder, "documents"))


@query("op11_infill", r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
hashed AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:], '') AS s
  FROM hashed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
""")
def op11(spark, folder):
    return infill.digests(read_table(spark, folder, "documents"))


@query("op12_one_bit_search", """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM pairs) WHERE rank <= 10
""")
def op12(spark, folder):
    return one_bit_search.nearest(read_table(spark, folder, "embeddings"))


@query("op13_whitening")
def op13(spark, folder):
    return whitening.whiten(read_table(spark, folder, "embeddings"))

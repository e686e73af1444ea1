"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES, ORACLES = {}, {}


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op2_content_sort(spark, folder):
    from fleetgauge.llm.exact_dedup import content_sort

    return content_sort(read(spark, folder, "documents"))


ORACLES["op2_content_sort"] = r"""
WITH bodies AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(body) AS text_sha256
FROM bodies WINDOW best AS (PARTITION BY body ORDER BY n_points DESC, doc_id NULLS LAST)
"""

#: The rules of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op3_range_join(spark, folder):
    from fleetgauge.llm.url_filter import url_verdicts

    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_verdicts(read(spark, folder, "pages"), rules)


ORACLES["op3_range_join"] = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), urls AS (
  SELECT page_id,
         lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), fits AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC) AS place
  FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""


@query
def op7_splitting_tree(spark, folder):
    from fleetgauge.llm.mixing import mix_plan

    return mix_plan(read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op9_rank_array(spark, folder):
    import public_tokenizers

    from fleetgauge.llm.bpe import token_digests

    return token_digests(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_rank_order(spark, folder):
    from fleetgauge.llm.language_id import language_of

    return language_of(read(spark, folder, "documents"))


@query
def op5_pivot_table(spark, folder):
    from fleetgauge.llm.simhash import near_copies

    return near_copies(read(spark, folder, "documents"))


@query
def op10_cross_polytope(spark, folder):
    from fleetgauge.llm.embedding_dedup import near_vectors

    return near_vectors(read(spark, folder, "embeddings"))


ORACLES["op10_cross_polytope"] = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), found AS (
  SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
         least(e.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id)) AS component_id
  FROM embeddings e
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
"""


@query
def op4_warc_index(spark, folder):
    from fleetgauge.llm.warc import archived

    return archived(read(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op4_warc_index"] = r"""
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), groups AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
         CASE WHEN octet_length(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS response
  FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN response IS NULL OR response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response <> page_id THEN response END AS refers_to
FROM groups
"""


@query
def op8_elias_fano(spark, folder):
    from fleetgauge.llm.lm_score import lm_scores

    return lm_scores(read(spark, folder, "documents"))


@query
def op1_feistel(spark, folder):
    from fleetgauge.llm.pseudonyms import with_pseudonyms

    # The key of this query is open, so that its results can be checked; a real one belongs in a vault.
    return with_pseudonyms(read(spark, folder, "documents"), key="open key of the registered query")


@query
def op13_crc_matrices(spark, folder):
    from fleetgauge.llm.resampling import resampled

    return resampled(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


ORACLES["op13_crc_matrices"] = r"""
WITH RECURSIVE bytes(b, c, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bytes WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS crc_of FROM bytes WHERE k = 8
), texts AS (
  SELECT true AS own, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT false, item_id, coalesce(text, '') FROM benchmark
), words AS (
  SELECT own, id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), features AS (
  SELECT own, row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                                list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM words
), counted AS (
  SELECT own, row_id, f, count(*) AS n FROM features GROUP BY ALL
), hexed AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                            lambda c, b: xor(c // 256, crc_of[xor(c % 256, b) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM hexed, crc_table
), in_buckets AS (
  SELECT range AS bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t
  FROM range(10000) LEFT JOIN (SELECT own, bucket, n FROM counted JOIN hashed USING (f)) ON bucket = range GROUP BY range
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM in_buckets
), weights AS (
  SELECT row_id, sum(n * gain) AS weight, sum(n) AS n_features FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE own GROUP BY row_id
), scores AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (row_id) WHERE own
), places AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, 5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank, n_words FROM places
"""


@query
def op11_jacobi_davidson(spark, folder):
    from fleetgauge.llm.whitening import whitened

    return whitened(read(spark, folder, "embeddings"))


@query
def op12_factorization_machine(spark, folder):
    from fleetgauge.llm.toxicity import toxicity

    return toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))

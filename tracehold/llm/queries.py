"""The operators over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracehold.llm import boosted_quality, golomb_dedup, kneser_ney, lattice_sampling, ordinal_toxicity, pair_maxscore, secret_owners, simhash_bktree, source_audit, suffix_dedup, template_decontam, token_files, warc_chunks
from tracehold.llm.common import table


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bktree.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal_toxicity.score(docs, ordinal_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return boosted_quality.score(docs, boosted_quality.fit(docs, boosted_quality.training_labels(table(spark, sf_dir, "labels"))))


def op5_lattice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text, and whether each decodes to the text it came from."""
    docs = table(spark, sf_dir, "documents")
    return lattice_sampling.round_trips(docs)


def op6_golomb_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golomb_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_owners.scan(table(spark, sf_dir, "documents"))


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.archive_round_trip(table(spark, sf_dir, "pages"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score(table(spark, sf_dir, "documents"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op13_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_maxscore.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_ordinal_toxicity, op3_template_decontam, op4_boosted_quality, op5_lattice_sampling, op6_golomb_dedup, op7_secret_owners, op8_warc_chunks, op9_simhash_bktree, op10_kneser_ney, op11_source_audit, op12_token_files, op13_pair_maxscore)}

ORACLES = {
    "op6_golomb_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op7_secret_owners": rf"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, coalesce(source, '') AS owner, coalesce(lang, '') AS lang FROM documents),
        p(kind, o, p) AS (VALUES ('assign', 0, '{secret_owners.ASSIGN.replace("'", "''")}'), ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+'), ('blob', 3, '{secret_owners.BLOB}')),
        g AS (SELECT r, owner, lang, kind, o, p, regexp_extract_all(x, p) AS hits, regexp_split_to_array(x, p) AS gaps FROM t, p),
        n AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM g WHERE len(hits) > 0),
        m AS (SELECT r, owner, lang, kind, o, hits[i] AS hit, CASE kind WHEN 'assign' THEN regexp_extract(hits[i], p, 1) ELSE hits[i] END AS v,
                     sum(length(gaps[i])) OVER w + coalesce(sum(length(hits[i])) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM n
              WINDOW w AS (PARTITION BY r, kind ORDER BY i)),
        s AS (SELECT r, owner, lang, kind, o, v, a, a + length(hit) AS b FROM m
              WHERE length(v) >= CASE kind WHEN 'assign' THEN 8 WHEN 'access' THEN 16 WHEN 'hex' THEN 32 ELSE 20 END
                AND (kind <> 'blob' OR (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')))),
        c AS (SELECT * FROM s WHERE kind <> 'blob' OR NOT EXISTS (SELECT 1 FROM s y WHERE y.r = s.r AND y.kind <> 'blob' AND y.a < s.b AND y.b > s.a)),
        h AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, lang)) AS repositories FROM c GROUP BY v),
        f AS (SELECT r, max(owners) AS most_owners, max(repositories) AS most_repositories, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                     sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (kind <> 'blob'), '')) AS base_sha256,
                     coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (kind <> 'blob' OR owners < {secret_owners.COPIED}), '') AS spans,
                     count(*) FILTER (owners < {secret_owners.COPIED}) AS n_live, count(*) FILTER (owners >= {secret_owners.COPIED} AND kind <> 'blob') AS n_copied
              FROM c JOIN h USING (v) GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
               coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
        FROM t LEFT JOIN f USING (r)""",
    "op8_warc_chunks": """
        WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM t)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to FROM f""",
    "op11_source_audit": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS x, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT DISTINCT lang, source FROM d),
        dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS p FROM dense WINDOW s AS (PARTITION BY lang, source)),
        l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER s + count(*) OVER s) AS q FROM dense GROUP BY lang, term WINDOW s AS (PARTITION BY lang)),
        t AS (SELECT p.lang, p.source, 'term' AS part, term AS item, (p.p - l.q) * (p.p - l.q) // l.q AS value FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q),
        v AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM t UNION ALL SELECT * FROM o))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200""",
    "op13_pair_maxscore": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        a AS (SELECT count(*) AS n, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
        i AS (SELECT DISTINCT k, item_id, term FROM (SELECT k, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
              FROM (SELECT row_number() OVER () AS k, * FROM benchmark))),
        t AS (SELECT r, doc_id, size, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS size, unnest(ws) AS term FROM d) SEMI JOIN i USING (term) GROUP BY r, doc_id, size, term),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, a GROUP BY term),
        s AS (SELECT k, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * n) // l))))::BIGINT AS score FROM t JOIN w USING (term) JOIN i USING (term), a GROUP BY k, item_id, r, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
}

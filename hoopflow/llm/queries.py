"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopflow.llm import align, bpe, centroids, decontam, langid, lines, minhash, packing, pii, quality, rules, substrings, suffix
from hoopflow.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL_OP1 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS c FROM t UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.id)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, t.doc_id = c.c AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) c ON c.id = t.doc_id
"""

SQL_OP2 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS MATERIALIZED (SELECT doc_id, o, substring(h, 2 * o + 1, 1122) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49, 512)) AS o FROM t)),
p AS MATERIALIZED (SELECT doc_id, o, o + i AS p, hash(substring(h, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, o, h, unnest(range(least(512, len(h) // 2 - 49))) AS i FROM s)),
r AS MATERIALIZED (SELECT k FROM p GROUP BY k HAVING min(doc_id) < max(doc_id)),
c AS MATERIALIZED (SELECT p.doc_id, p.p, substring(s.h, 2 * (p.p - p.o) + 1, 100) AS w FROM p JOIN r USING (k) JOIN s ON s.doc_id = p.doc_id AND s.o = p.o),
b AS (SELECT c.doc_id, c.p FROM c JOIN (SELECT w, min(doc_id) AS first FROM c GROUP BY w) m ON m.w = c.w AND m.first < c.doc_id),
e AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS opens FROM b),
g AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM e),
u AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM g GROUP BY doc_id, s),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM u),
x AS (SELECT k.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substring(t.h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept, max(z) AS last FROM k JOIN t ON t.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN x ON x.doc_id = t.doc_id
"""

SQL_OP7 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS p FROM t),
s AS (SELECT doc_id, p, w[p] AS x, n - p >= 19 AS full_window, CASE WHEN n - p >= 19 THEN array_to_string(w[p:p + 19], ' ') END AS s FROM p),
b AS (SELECT doc_id, p, x, full_window AND row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS bad FROM s),
c AS (SELECT doc_id, p, x, max(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM b),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN g USING (doc_id)
"""

SQL_OP9 = r"""
WITH l AS (SELECT doc_id, source, i, line FROM (SELECT doc_id, source, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
hosts AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT f.source, f.line FROM (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line) f JOIN hosts h USING (source) WHERE n >= 5 AND n > 0.05 * pages),
k AS (SELECT l.doc_id, l.i, l.line, b.line IS NOT NULL AS gone FROM l LEFT JOIN bad b ON b.source = l.source AND b.line = l.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id
"""


@query("op1_minhash", SQL_OP1)
def op1(spark, sf_dir):
    """Components of documents whose 4-word shingle sets have a similarity of 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80).drop("n_links")


@query("op2_suffix_array", SQL_OP2)
def op2(spark, sf_dir):
    """Bytes left after 50-byte strings of documents with smaller ids are removed."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), length=50).drop("kept")


@query("op3_quality_rules")
def op3(spark, sf_dir):
    """Base measures and the posterior verdict of the quality rules."""
    return rules.quality_rules(table(spark, sf_dir, "documents"))


@query("op4_personal_data")
def op4(spark, sf_dir):
    """Spans of personal data."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op5_best_fit_packing")
def op5(spark, sf_dir):
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op6_language")
def op6(spark, sf_dir):
    """Predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op7_substring", SQL_OP7)
def op7(spark, sf_dir):
    """Words left after 20-word windows that start earlier are removed."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=20).drop("kept")


@query("op8_decontamination")
def op8(spark, sf_dir):
    """Documents that hold at least half of a benchmark item in tiles of five words or more."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_line_dedup", SQL_OP9)
def op9(spark, sf_dir):
    """Lines on more than 5 % of a source's documents are removed."""
    return lines.line_report(table(spark, sf_dir, "documents"))


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    """Quality score of every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_alignment")
def op11(spark, sf_dir):
    """Groups and links of two tokenizers' tokens, with corpus-wide counts of linked ids."""
    found = align.align(table(spark, sf_dir, "documents"))
    return found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")


@query("op12_centroids", centroids.cluster_sql())
def op12(spark, sf_dir):
    """Ten rounds of eight centroids over all valid embeddings."""
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


@query("op13_bpe")
def op13(spark, sf_dir):
    """Ids and decoded text of every document."""
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("pipeline")
def pipeline(spark, sf_dir):
    """All stages of corpus_pipeline.py, each on what the one before kept."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)

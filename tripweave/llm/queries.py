"""One query for each training-data operator, over its whole table, with DuckDB SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import exact_dedup, license_scan, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, url_filter, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_source_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken_words(mixing.mix(table(spark, sf_dir, "documents")))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot", "pieces")


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_rules.label_quality(documents, quality_rules.fit(documents, good_labels(spark, sf_dir)))


_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (v // {}) % 32 AS BIGINT), 1)"


@query(
    "op3_warc",
    f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
      five AS (SELECT sha, k, CAST('0x' || substr(sha, 5 * k + 1, 5) AS BIGINT) AS v FROM (SELECT DISTINCT sha FROM p) AS s, range(8) AS g(k)),
      d AS (SELECT sha, string_agg(concat({", ".join(_BASE32.format(32**n) for n in (3, 2, 1, 0))}), '' ORDER BY k) AS payload_digest FROM five GROUP BY sha),
      r AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY page_id DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY sha) AS top FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
    FROM r JOIN d USING (sha)""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.scratch_path(spark)
    warc.archive(table(spark, sf_dir, "pages"), path)
    back = warc.read_archive(spark, path, verify="true")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), model_path()), "corrected")


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), good_labels(spark, sf_dir)
    return quality_classifier.classify(documents, labels, quality_classifier.fit(documents, labels))


@query(
    "op7_exact_dedup",
    r"""
    WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                      sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
         r AS (SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS c
               FROM t WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id NULLS LAST))
    SELECT doc_id, keep_id, c AS group_size, k = 1 AS kept, sha AS text_sha256 FROM r""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_exact_copies(table(spark, sf_dir, "documents"))


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, good = table(spark, sf_dir, "documents"), good_labels(spark, sf_dir).filter("good = 1")
    ordinary = secret_scan.ordinary_strings(documents, good, "doc_id", "text")
    ratio = secret_scan.train_ratio(secret_scan.random_strings(spark).unionByName(ordinary))
    found = secret_scan.scan_secrets(documents, ratio)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pages: bad if of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(bad, 1).otherwise(0).alias("bad"))


_TWO = ", ".join(f"'{s}'" for s in url_filter.TWO_LABEL_SUFFIXES)


def _strength_sql(level: str) -> str:
    return f"""k_{level} AS (SELECT CASE WHEN n - nn / n > 0 AND bb - b * p - (j - 1) * p * (1 - p) > 0
        THEN greatest(1.0, least(1000.0, p * (1 - p) / ((bb - b * p - (j - 1) * p * (1 - p)) / (n - nn / n)) - 1)) ELSE 1000.0 END AS k, p
      FROM (SELECT *, b / n AS p FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS b, CAST(sum(n * n) AS DOUBLE) AS nn,
            CAST(sum(CAST(bad * bad AS DOUBLE) / n) AS DOUBLE) AS bb, CAST(count(*) AS DOUBLE) AS j FROM by_{level})))"""


@query(
    "op9_url_filter",
    rf"""
    WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
                      regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
      v AS (SELECT *, string_split(host, '.') AS p, array_to_string(string_split(host, '.')[-2:], '.') IN ({_TWO}) AS two FROM u),
      w AS (SELECT page_id, host, path, CASE WHEN two THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix,
                   CASE WHEN two THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM v),
      m AS (SELECT doc_id AS id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
      hosts AS (SELECT host, domain, suffix, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM w LEFT JOIN m ON id = page_id GROUP BY 1, 2, 3),
      by_host AS (SELECT * FROM hosts WHERE n > 0),
      by_domain AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM by_host GROUP BY 1, 2),
      by_suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM by_domain GROUP BY 1),
      {_strength_sql("host")}, {_strength_sql("domain")}, {_strength_sql("suffix")},
      ps AS (SELECT suffix, (bad + k * p) / (n + k) AS p_suffix FROM by_suffix, k_suffix),
      pd AS (SELECT domain, (bad + k * p_suffix) / (n + k) AS p_domain FROM by_domain JOIN ps USING (suffix), k_domain),
      q AS (SELECT host, (bad + k * coalesce(p_domain, p_suffix, p)) / (n + k) AS p_bad, n + k AS nk
            FROM hosts LEFT JOIN pd USING (domain) LEFT JOIN ps USING (suffix), k_host),
      own AS (SELECT host, p_bad - {url_filter.Z} * sqrt(p_bad * (1 - p_bad) / (nk + 1)) > {url_filter.MAX_BAD} AS bad_host FROM q),
      r(verdict, rh, rp) AS (VALUES {", ".join(str(x) for x in url_filter.RULES)}),
      f AS (SELECT page_id, host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(r.verdict, length(rh || rp)) AS v
            FROM (SELECT DISTINCT page_id, host, path FROM w) x, r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2, 3)
    SELECT w.page_id, w.host, w.path, f.rule, coalesce(f.v, CASE WHEN bad_host THEN 'block' ELSE 'allow' END) AS verdict
    FROM w JOIN own USING (host) LEFT JOIN f ON f.page_id IS NOT DISTINCT FROM w.page_id AND f.host = w.host AND f.path = w.path""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op10_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)

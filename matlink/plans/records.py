"""Queries on records: ingest, quality, review, audit and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.functions import text as T
from matlink.operators import evaluate, governance, records

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- ingest ----
@query("SELECT o_custkey AS code, o_orderkey AS row FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) AS t WHERE n = 1")
def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each customer stands for that of an org and code."""
    return records.latest(_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("row"))


@query("SELECT o_custkey AS code, min(o_orderkey) AS row FROM orders GROUP BY o_custkey")
def first_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first(_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey").select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("row"))


_HASH_SQL = "sha256(concat('code=', CAST(p_partkey AS STRING), chr(31), 'text=', p_name, chr(31), 'brand=', p_brand))"


@query(f"SELECT p_partkey AS id, {_HASH_SQL} AS hash FROM part")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.content_hash(code=F.col("p_partkey"), text=F.col("p_name"), brand=F.col("p_brand")).alias("hash"))


@query("SELECT CAST(p_partkey AS STRING) AS legacy_code FROM part WHERE p_partkey % 3 <> 0")
def unchanged_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that aren't known yet, where every third is."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("legacy_code"), T.content_hash(name=F.col("p_name")).alias("content_hash"))
    return records.changed(rows, rows.where("legacy_code % 3 = 0")).select("legacy_code")


@query("SELECT s_suppkey AS id, sha256(concat('salt', trim(s_name))) AS hash FROM supplier")
def vendor_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), T.vendor_hash(F.lit("salt"), F.col("s_name")).alias("hash"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN NULL ELSE round(o_totalprice, 2) END AS number, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and dates written in several ways, and some that are none."""
    price = F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")
    number = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("INR "), price)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("-"), price)).otherwise(F.concat(F.lit(" "), price, F.lit("/-")).substr(F.lit(1), F.length(price) + 1))
    day = F.col("o_orderdate")
    written = F.lit("n/a")
    for i, f in enumerate(("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd")):
        written = F.when(F.col("o_orderkey") % 5 == i, F.date_format(day, f)).otherwise(written)
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.lenient_number(number).cast("double").alias("number"), T.lenient_date(written).alias("day"))


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE ELSE NULL END AS critical FROM events")
def criticality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, (" y", "No", "TRUE", "maybe"))), (F.col("event_id") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.criticality(raw).alias("critical"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN concat(chr(39), '=', event_type) WHEN event_id % 3 = 1 THEN concat(chr(39), '-', event_type) ELSE event_type END AS cell FROM events")
def guarded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("="), "event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("-"), "event_type")).otherwise(F.col("event_type"))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.safe_cell(raw).alias("cell"))


_QUALITY_SQL = """WITH r AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END AS short_text, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS category, (p_partkey % 5) / 4.0 AS completeness,
  CASE p_partkey % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'ambiguous' ELSE 'ok' END AS unit_state, p_partkey % 20 = 19 AS repeated FROM part),
a AS (SELECT count(*) FILTER (WHERE NOT repeated) AS rows, count(*) AS total, count(*) FILTER (WHERE NOT repeated AND length(short_text) > 40) AS over_40, count(*) FILTER (WHERE repeated) AS repeated,
  count(*) FILTER (WHERE NOT repeated AND unit_state = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE NOT repeated AND trim(short_text) <> '') AS f, count(*) FILTER (WHERE NOT repeated AND category IS NOT NULL) AS c,
  avg(completeness) FILTER (WHERE NOT repeated AND category IS NOT NULL) AS m, count(*) FILTER (WHERE NOT repeated AND unit_state = 'ok') AS u FROM r),
b AS (SELECT *, round_even(f / rows, 4) AS descriptions, round_even(rows / total, 4) AS unique_codes, round_even(c / rows, 4) AS recognised, round_even(m, 4) AS completeness, round_even(u / rows, 4) AS units FROM a)
SELECT rows, over_40, repeated, ambiguous, descriptions, unique_codes, recognised, completeness, units, CAST(round_even(100 * (descriptions + unique_codes + recognised + completeness + units) / 5, 0) AS INT) AS health FROM b"""


@query(_QUALITY_SQL)
def batch_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part").select(
        F.when(k % 10 == 0, "").otherwise(F.col("p_name")).alias("short_text"), F.when(k % 7 != 0, F.col("p_type")).alias("category"), (k % 5 / 4.0).alias("completeness"),
        F.when(k % 6 == 0, "unknown").when(k % 6 == 1, "ambiguous").otherwise("ok").alias("unit_state"), (k % 20 == 19).alias("repeated"),
    )
    return records.quality(rows)


# ---- review and audit: events are the log ----
_ACTIONS = "PROPOSE,APPROVE,ASK,CONSENT,OVERTURN"


def review_sql(select: str) -> str:
    """SQL of the states s (task, state, steps) after all of the log, and a query on them."""
    return f"""WITH RECURSIVE e AS (SELECT user_id AS task, split_part('{_ACTIONS}', ',', CAST(event_id % 5 + 1 AS INT)) AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT DISTINCT task, CAST('OPEN' AS VARCHAR) AS state, CAST(0 AS BIGINT) AS n FROM e
  UNION ALL SELECT w.task, CASE WHEN w.state = 'OPEN' AND action = 'PROPOSE' THEN 'MADE' WHEN w.state = 'MADE' AND action = 'APPROVE' THEN 'DONE' WHEN w.state = 'MADE' AND action = 'ASK' THEN 'AWAITING_CONSENT'
    WHEN w.state = 'MADE' AND action = 'OVERTURN' THEN 'OPEN' WHEN w.state = 'AWAITING_CONSENT' AND action = 'CONSENT' THEN 'DONE' WHEN w.state = 'AWAITING_CONSENT' AND action = 'OVERTURN' THEN 'OPEN' ELSE w.state END, e.n
  FROM w JOIN e ON e.task = w.task AND e.n = w.n + 1),
s AS (SELECT task, state, n AS steps FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC) AS k FROM w) AS z WHERE k = 1)
{select}"""


@query(review_sql("SELECT task, state, steps FROM s"))
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.element_at(F.split(F.lit(_ACTIONS), ","), (F.col("event_id") % 5 + 1).cast("int"))
    return governance.review_states(_table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("pos"), action.alias("action")))


@query("SELECT DISTINCT event_type AS cluster, user_id % 10 AS org FROM events WHERE user_id % 10 NOT IN (SELECT user_id % 10 FROM events AS e WHERE e.event_type = events.event_type AND e.event_id % 97 = 0)")
def consent_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("cluster"), (F.col("user_id") % 10).alias("org"), "event_id")
    return governance.missing_consents(e, e.where("event_id % 97 = 0").select("cluster", "org").distinct())


@query("SELECT s_nationkey AS org, concat('R', CAST(s_suppkey % 3 AS STRING)) AS code, count(*) AS records, string_agg(s_name, ',' ORDER BY s_name) AS delta FROM supplier GROUP BY 1, 2")
def change_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("org"), F.concat(F.lit("R"), (F.col("s_suppkey") % 3).cast("string")).alias("code"), F.col("s_name").alias("legacy_code"), F.lit("MAP").alias("action"))
    return governance.notices(rows).select("org", "code", "records", F.array_join(F.transform("delta", lambda d: d["legacy_code"]), ",").alias("delta"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 500).alias("chain"), F.col("event_id").alias("id"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("payload"))


@query("""WITH RECURSIVE e AS (SELECT event_id // 500 AS chain, event_id AS id, concat(CAST(user_id AS STRING), '|', event_type) AS payload, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS n FROM events),
c AS (SELECT chain, id, n, sha256(concat('GENESIS', payload)) AS hash FROM e WHERE n = 1 UNION ALL SELECT e.chain, e.id, e.n, sha256(concat(c.hash, e.payload)) FROM c JOIN e ON e.chain = c.chain AND e.n = c.n + 1)
SELECT chain, id, hash FROM c""")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.chain(_log(spark, sf_dir)).select("chain", "id", "hash")


@query("SELECT event_id // 500 AS chain, count(*) AS rows, CAST(min(CASE WHEN event_id % 1000 = 777 THEN event_id END) AS BIGINT) AS first_bad FROM events GROUP BY 1")
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bad row of each chain, after one row in some was changed."""
    log = governance.chain(_log(spark, sf_dir)).withColumn("payload", F.when(F.col("id") % 1000 == 777, "changed").otherwise(F.col("payload")))
    return governance.verify(log)


@query("SELECT event_id AS id, event_type AS action FROM events WHERE event_id < 150 ORDER BY event_id DESC LIMIT 50")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the log (keyset paging)."""
    return governance.page(_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action")), 150, 50)


# ---- evaluation: labels are the truth, text length the score ----
def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return docs.join(_table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", (F.col("quality") == 1).alias("truth"), (F.least(F.col("n_chars"), F.lit(2000)) / 2000.0).alias("score"))


_SCORED_SQL = "s AS (SELECT d.doc_id, lang, quality = 1 AS truth, least(n_chars, 2000) / 2000.0 AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"""WITH {_SCORED_SQL}, p AS (SELECT lang, truth, score >= 0.5 AS positive, score < 0.4 OR score >= 0.5 AS decided FROM s),
c AS (SELECT lang, count(*) FILTER (WHERE positive AND decided AND truth) AS tp, count(*) FILTER (WHERE positive AND decided AND NOT truth) AS fp, count(*) FILTER (WHERE NOT positive AND decided AND truth) AS fn,
  count(*) FILTER (WHERE NOT decided) AS abstained, count(*) FILTER (WHERE truth) AS t, count(*) AS pairs FROM p GROUP BY lang)
SELECT lang, tp, fp, fn, abstained, pairs, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(t, 0), 6) AS strict_recall, round(tp / nullif(tp + fn, 0), 6) AS decided_recall, round((pairs - abstained) / pairs, 6) AS coverage,
  round(CASE WHEN tp + fp = 0 THEN 1 WHEN fp = 0 THEN least(1, 3 / (tp + fp)) ELSE least(1, ((fp / (tp + fp)) + 1.96 * 1.96 / (2 * (tp + fp)) + 1.96 * sqrt((fp / (tp + fp)) * (1 - fp / (tp + fp)) / (tp + fp) + 1.96 * 1.96 / (4 * (tp + fp) * (tp + fp)))) / (1 + 1.96 * 1.96 / (tp + fp))) END, 6) AS false_merge_upper FROM c""")
def evaluation_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    rows = _scored(spark, sf_dir).select("lang", "truth", (s >= 0.5).alias("positive"), ((s < 0.4) | (s >= 0.5)).alias("decided"))
    rates = ["precision", "strict_recall", "decided_recall", "coverage", "false_merge_upper"]
    return evaluate.confusion(rows, "lang").withColumns({c: F.round(c, 6) for c in rates})


@query(f"""WITH {_SCORED_SQL}, g AS (SELECT t.tau, count(*) FILTER (WHERE truth AND floor(round(score * 100, 6)) >= tau) AS tp, count(*) FILTER (WHERE NOT truth AND floor(round(score * 100, 6)) >= tau) AS fp, count(*) FILTER (WHERE truth AND floor(round(score * 100, 6)) < tau) AS fn
  FROM s, (SELECT CAST(unnest(range(50, 100)) AS INT) AS tau) AS t GROUP BY t.tau), f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM g)
SELECT tau, tp, fp, fn, round(f1, 6) AS f1, tau = (SELECT tau FROM f ORDER BY round(f1, 12) DESC, tau LIMIT 1) AS best FROM f""")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_grid(_scored(spark, sf_dir)).withColumn("f1", F.round("f1", 6))

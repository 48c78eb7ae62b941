"""Queries on the purchase history made of lineitem and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.operators.money import idle_stock, price_gaps, trailing_year, weighted_prices


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as purchases: item is the part, org the supplier's nation."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").alias("org"))
    return lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
        F.col("l_partkey").alias("item"),
        "org",
        F.to_date("l_shipdate").alias("po_date"),
        F.col("l_quantity").alias("qty"),
        F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
        F.col("l_suppkey").alias("vendor"),
    )


PO_SQL = """po AS (
  SELECT l_partkey AS item, s_nationkey AS org, CAST(l_shipdate AS DATE) AS po_date, l_quantity AS qty,
         l_extendedprice / NULLIF(l_quantity, 0) AS unit_price, l_suppkey AS vendor
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

PRICES_SQL = f"""{PO_SQL}, recent AS (
  SELECT * FROM po WHERE po_date > (SELECT MAX(po_date) FROM po) - INTERVAL 12 MONTH),
prices AS (
  SELECT item, org, SUM(qty) AS qty, SUM(qty * unit_price) / NULLIF(SUM(qty), 0) AS price
  FROM recent WHERE unit_price IS NOT NULL GROUP BY item, org HAVING NULLIF(SUM(qty), 0) IS NOT NULL),
gaps AS (
  SELECT item, COUNT(*) AS orgs, MIN(price) AS min_price, MAX(price) AS max_price,
         SUM(qty * price) AS pooled_spend, SUM(qty * price) - MIN(price) * SUM(qty) AS gap_value
  FROM prices GROUP BY item HAVING COUNT(*) >= 2)"""


def price_gap_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten items with the largest spend above the lowest price (a top-k report)."""
    gaps = price_gaps(weighted_prices(trailing_year(purchases(spark, sf_dir))))
    return gaps.select("item", "orgs", F.round("min_price", 6).alias("min_price"), F.round("max_price", 6).alias("max_price"), F.round("gap_value", 0).alias("gap_value")).orderBy(F.desc("gap_value"), "item").limit(10)


QUERIES = {"price_gap_top": price_gap_top}
ORACLE_SQL = {
    "price_gap_top": f"""WITH {PRICES_SQL}
SELECT item, orgs, ROUND(min_price, 6) AS min_price, ROUND(max_price, 6) AS max_price, ROUND(gap_value, 0) AS gap_value
FROM gaps ORDER BY gap_value DESC, item LIMIT 10""",
}


def group_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted average price of each item and org in the trailing year."""
    prices = weighted_prices(trailing_year(purchases(spark, sf_dir)))
    return prices.select("item", "org", F.round("qty", 2).alias("qty"), F.round("price", 9).alias("price"))


def pooled_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = price_gaps(weighted_prices(trailing_year(purchases(spark, sf_dir))))
    return gaps.agg(F.count("*").alias("items"), F.round(F.sum("pooled_spend"), 0).alias("pooled_spend"), F.round(F.sum("gap_value"), 0).alias("gap_value"))


def annual_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing-year quantity and value of each item."""
    recent = trailing_year(purchases(spark, sf_dir))
    return recent.groupBy("item").agg(F.round(F.sum("qty"), 2).alias("annual_qty"), F.round(F.sum(F.col("qty") * F.col("unit_price")), 0).alias("annual_value"))


def stock_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idle stock of one org against purchases of another in the same group: one pick a group and holder.

    Parts of a name are a group; every fifth holds stock.
    """
    po = purchases(spark, sf_dir)
    recent = trailing_year(po).groupBy("item").agg(F.sum("qty").alias("qty_12m"))
    per_item = po.groupBy("item").agg(F.max("po_date").alias("last_po"), F.avg("unit_price").alias("price"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("item"), F.concat("p_name", F.lit("#"), F.col("p_size").cast("string")).alias("cluster"), F.col("p_brand").alias("org"), F.when(F.col("p_partkey") % 5 == 0, F.lit(40.0)).otherwise(0.0).alias("stock"))
    rec = part.join(per_item, "item", "left").join(recent, "item", "left").withColumn("qty_12m", F.coalesce("qty_12m", F.lit(0.0)))
    return idle_stock(rec, po.agg(F.max("po_date").alias("as_of")))


QUERIES |= {f.__name__: f for f in (group_prices, pooled_spend, annual_figures, stock_sharing)}
ORACLE_SQL |= {
    "group_prices": f"WITH {PRICES_SQL} SELECT item, org, ROUND(qty, 2) AS qty, ROUND(price, 9) AS price FROM prices",
    "pooled_spend": f"WITH {PRICES_SQL} SELECT COUNT(*) AS items, ROUND(SUM(pooled_spend), 0) AS pooled_spend, ROUND(SUM(gap_value), 0) AS gap_value FROM gaps",
    "annual_figures": f"WITH {PRICES_SQL} SELECT item, ROUND(SUM(qty), 2) AS annual_qty, ROUND(SUM(qty * unit_price), 0) AS annual_value FROM recent GROUP BY item",
    "stock_sharing": f"""WITH {PRICES_SQL}, cutoff AS (SELECT MAX(po_date) - INTERVAL 12 MONTH AS d FROM po),
q AS (SELECT item, SUM(qty) AS qty_12m FROM recent GROUP BY item), l AS (SELECT item, MAX(po_date) AS last_po, AVG(unit_price) AS price FROM po GROUP BY item),
rec AS (SELECT p_partkey AS item, concat(p_name, '#', CAST(p_size AS STRING)) AS cluster, p_brand AS org, CASE WHEN p_partkey % 5 = 0 THEN 40.0 ELSE 0.0 END AS stock, last_po, price, COALESCE(qty_12m, 0) AS qty_12m
  FROM part LEFT JOIN l ON l.item = p_partkey LEFT JOIN q ON q.item = p_partkey),
s AS (SELECT h.cluster, h.org AS holder, h.item AS holder_item, b.item AS buyer_item, LEAST(h.stock, b.qty_12m) AS transferable, ROUND(LEAST(h.stock, b.qty_12m) * COALESCE(b.price, 0), 4) AS value
  FROM rec h JOIN rec b ON h.cluster = b.cluster AND h.org <> b.org, cutoff WHERE h.stock > 0 AND (h.last_po IS NULL OR h.last_po <= cutoff.d) AND b.qty_12m > 0)
SELECT cluster, holder, holder_item, buyer_item, CAST(transferable AS DOUBLE) AS transferable, CAST(ROUND(value, 0) AS DOUBLE) AS value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster, holder ORDER BY value DESC, holder_item, buyer_item) AS n FROM s) AS z WHERE n = 1""",
}

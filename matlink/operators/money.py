"""Money views of a purchase history: weighted prices, price gaps, pooled spend, annual figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_year(purchases: DataFrame) -> DataFrame:
    """Purchases after the latest purchase date less 12 months; the date is one row, joined as such."""
    last = purchases.agg(F.max("po_date").alias("as_of"))
    return purchases.join(F.broadcast(last), F.col("po_date") > F.expr("as_of - INTERVAL '12' MONTH")).drop("as_of")


def weighted_prices(purchases: DataFrame) -> DataFrame:
    """(item, org): quantity and quantity-weighted average price of priced purchases."""
    return (
        purchases.where("unit_price is not null")
        .groupBy("item", "org")
        .agg(F.sum("qty").alias("qty"), F.try_divide(F.sum(F.col("qty") * F.col("unit_price")), F.sum("qty")).alias("price"))
        .where("price is not null")
    )


def price_gaps(prices: DataFrame) -> DataFrame:
    """Items bought by two or more orgs: spend above the lowest org price, and pooled spend."""
    low = prices.groupBy("item").agg(
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.count("*").alias("orgs"),
        F.sum(F.col("qty") * F.col("price")).alias("pooled_spend"),
        F.sum("qty").alias("total_qty"),
    )
    return low.where("orgs >= 2").select(
        "item", "orgs", "min_price", "max_price", "pooled_spend", (F.col("pooled_spend") - F.col("min_price") * F.col("total_qty")).alias("gap_value")
    )


def idle_stock(records: DataFrame, as_of: DataFrame) -> DataFrame:
    """Per group and holder, the best transfer of stock unused for 12 months to an org that keeps buying.

    records: cluster, org, item, stock, last_po, price, qty_12m. Ties go to the lowest items.
    """
    rows = records.crossJoin(F.broadcast(as_of))  # one row
    holders = rows.where("stock > 0 and (last_po is null or last_po <= as_of - INTERVAL '12' MONTH)").select("cluster", F.col("org").alias("holder"), F.col("item").alias("holder_item"), "stock")
    buyers = rows.where("qty_12m > 0").select("cluster", F.col("org").alias("buyer"), F.col("item").alias("buyer_item"), "price", "qty_12m")
    moved = F.least("stock", "qty_12m")
    found = holders.join(buyers, "cluster").where("holder <> buyer").withColumns({"transferable": moved, "value": F.round(moved * F.coalesce("price", F.lit(0.0)), 4)})
    best = Window.partitionBy("cluster", "holder").orderBy(F.desc("value"), "holder_item", "buyer_item")
    picks = found.withColumn("n", F.row_number().over(best)).where("n = 1")
    return picks.select("cluster", "holder", "holder_item", "buyer_item", "transferable", F.round("value", 0).alias("value"))

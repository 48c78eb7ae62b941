"""Views on the given tables that the queries share, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.operators.candidates import block_value
from matlink.operators.extract import text_specs

_NPS = "1/2,3/4,1,1-1/4,1-1/2,2,2-1/2,3,4,5,6,8,10,12,14,16,18,20,24"
_DN = "15,20,25,32,40,50,65,80,100,125,150,200,250,300,350,400,450,500,600"

#: Items written by three orgs in a style of their own: entity k of part, style, and true attributes.
ITEMS_SQL = f"""items AS (
  SELECT id, k, style, split_part('VALVE,PIPE,FLANGE,FASTENER,MOTOR', ',', CAST(k % 5 + 1 AS INT)) AS category,
         split_part('{_NPS}', ',', CAST(k % 19 + 1 AS INT)) AS nps, split_part('{_DN}', ',', CAST(k % 19 + 1 AS INT)) AS dn,
         split_part('150,300,600', ',', CAST(k % 3 + 1 AS INT)) AS cls, split_part('GATE,GLOBE,CHECK,BALL', ',', CAST(k % 4 + 1 AS INT)) AS vt,
         split_part('GV,GLV,CV,BV', ',', CAST(k % 4 + 1 AS INT)) AS vshort, split_part('40,80,160', ',', CAST(k % 3 + 1 AS INT)) AS sch,
         split_part('WN,SO,BLIND', ',', CAST(k % 3 + 1 AS INT)) AS ft, split_part('WELD NECK,SLIP ON,BLIND', ',', CAST(k % 3 + 1 AS INT)) AS flong,
         split_part('12,16,20,24', ',', CAST(k % 4 + 1 AS INT)) AS m, CAST(20 + 5 * (k % 17) AS STRING) AS len,
         split_part('8.8,10.9,B7', ',', CAST(k % 3 + 1 AS INT)) AS grade, split_part('BOLT,STUD,SCREW', ',', CAST(k % 3 + 1 AS INT)) AS bolt,
         CAST(1 + k % 90 AS STRING) AS kw, split_part('2,4,6', ',', CAST(k % 3 + 1 AS INT)) AS poles
  FROM (SELECT p_partkey AS id, CAST(FLOOR(p_partkey / 3.0) AS BIGINT) AS k, p_partkey % 3 AS style FROM part) AS p)"""

TEXTS_SQL = f"""{ITEMS_SQL}, texts AS (
  SELECT *, CASE category
    WHEN 'VALVE' THEN CASE style WHEN 0 THEN concat('VALVE ', vt, ' ', nps, 'IN CL', cls, ' A216 WCB FLGD RF')
                                 WHEN 1 THEN concat('Valve, ', lower(vt), ', ', nps, ' INCH, CLASS ', cls, ', ASTM A216 WCB, Flanged Raised Face')
                                 ELSE concat('VALVE ', vshort, ' ', dn, 'NB ', cls, '# WCB FLGD RF') END
    WHEN 'PIPE' THEN CASE style WHEN 0 THEN concat('PIPE SMLS ', nps, 'IN SCH', sch, ' A106 B')
                                WHEN 1 THEN concat('Pipe, seamless, ', nps, ' inch, SCH. ', sch, ', ASTM A106 GR.B')
                                ELSE concat('PIEP DN', dn, ' SCHEDULE ', sch, ' A106 GRADE B') END
    WHEN 'FLANGE' THEN CASE style WHEN 0 THEN concat('FLG ', ft, ' ', nps, 'IN CL', cls, ' RF A105')
                                  WHEN 1 THEN concat('Flange, ', lower(flong), ', ', nps, ' IN, CLASS ', cls, ', raised face, ASTM A105')
                                  ELSE concat('LFANGE ', flong, ' ', dn, ' NB ', cls, ' # RF A105') END
    WHEN 'FASTENER' THEN CASE style WHEN 0 THEN concat(bolt, ' HEX M', m, 'X', len, ' GR', grade, ' ZN')
                                    WHEN 1 THEN concat(lower(bolt), ', hex head, M', m, ' X ', len, ', grade ', grade, ', zinc plated')
                                    ELSE concat(bolt, ' M', m, 'x', len, ' ', grade, ' HEX HD ZINC') END
    ELSE CASE style WHEN 0 THEN concat('MOTOR AC IND ', kw, 'KW ', poles, 'P')
                    WHEN 1 THEN concat('Motor, AC, induction, ', kw, ' kW, ', poles, ' pole')
                    ELSE concat('AC MOTOR SQ CAGE ', kw, ' KW ', poles, ' POLES') END
    END AS text FROM items)"""


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, k, style, true attributes and text of each part as an item."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return spark.sql(f"WITH {TEXTS_SQL} SELECT * FROM texts".replace("FROM part)", "FROM {part})"), part=part)


def item_part_number() -> list[Column]:
    """Maker and part number of the items that have them, from k."""
    known = F.col("k") % 7 == 0
    return [F.when(known, "ACME").alias("maker"), F.when(known, F.concat(F.lit("P"), F.col("k").cast("string"))).alias("mpn")]


def item_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs of the items, with org (the style), maker, part number and block."""
    own = item_texts(spark, sf_dir).select("id", "text", F.col("style").cast("string").alias("org"), *item_part_number(), F.lit(None).cast("boolean").alias("critical"))
    return text_specs(own).withColumn("block", block_value(F.col("category"), F.col("attrs")))


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as records: id, org (brand), category (type), block (size), text."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("org"), F.col("p_type").alias("category"), F.col("p_size").alias("block"), F.upper("p_name").alias("text"), F.col("p_retailprice").alias("price"))


MATERIALS_SQL = "mat AS (SELECT p_partkey AS id, p_brand AS org, p_type AS category, p_size AS block, upper(p_name) AS text, p_retailprice AS price FROM part)"

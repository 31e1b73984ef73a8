"""Matrices made of the driver's tables, and the same in SQL: suppliers are samples, parts or groups of parts are features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code():
    return F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by brand and size: the largest price, and as mask valid for flag N, matched for A, below detection for R."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", F.lit("#"), F.col("p_size").cast("string")).alias("feature_id"))
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("sample_id"), "l_extendedprice", _code().alias("code"))
    return lines.join(part, "l_partkey").groupBy("sample_id", "feature_id").agg(F.max("l_extendedprice").alias("value"), F.max("code").alias("mask"))


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by part."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("sample_id"), F.col("l_partkey").cast("string").alias("feature_id"), "l_extendedprice", _code().alias("code"))
    return lines.groupBy("sample_id", "feature_id").agg(F.max("l_extendedprice").alias("value"), F.max("code").alias("mask"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to brands."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source_id"), F.col("p_brand").alias("target_id"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their region as batch and a group of nations."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    s = read(spark, sf_dir, "supplier")
    group = F.concat(F.lit("g"), (F.col("s_nationkey") % 3).cast("string"))
    return s.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("sample_id"), F.col("n_regionkey").cast("string").alias("batch"), group.alias("group"))


CODE_SQL = "case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end"
CELLS_SQL = f"cells as (select cast(l_suppkey as varchar) as sample_id, p_brand || '#' || cast(p_size as varchar) as feature_id, max(l_extendedprice) as value, max({CODE_SQL}) as mask from lineitem join part on l_partkey = p_partkey group by 1, 2)"
PEPTIDES_SQL = f"peptides as (select cast(l_suppkey as varchar) as sample_id, cast(l_partkey as varchar) as feature_id, max(l_extendedprice) as value, max({CODE_SQL}) as mask from lineitem group by 1, 2)"
LINKS_SQL = "links as (select cast(p_partkey as varchar) as source_id, p_brand as target_id from part)"
OBS_SQL = "obs as (select cast(s_suppkey as varchar) as sample_id, cast(n_regionkey as varchar) as batch, 'g' || cast(s_nationkey % 3 as varchar) as grp from supplier join nation on s_nationkey = n_nationkey)"
GRID_SQL = "grid as (select s.sample_id, f.feature_id, c.value, coalesce(c.mask, 6) as mask from (select distinct sample_id from cells) s cross join (select distinct feature_id from cells) f left join cells c using (sample_id, feature_id))"
LOGGED_SQL = "logged as (select sample_id, feature_id, ln(value + 1) / ln(2) as value, mask from cells)"
PROTEINS_SQL = "proteins as (select sample_id, target_id as feature_id, avg(value) as value, max(mask) as mask from peptides join links on feature_id = source_id group by 1, 2)"

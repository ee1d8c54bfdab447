"""The response log as the driver's tables hold it, and its SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from responsa.functions import keys, normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, display_name, organization, family, macro_family of each subject."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").cast("string").alias("subject_id"), F.col("s_name").alias("display_name"), F.col("n_name").alias("organization"), F.col("n_name").alias("family"), F.col("r_name").alias("macro_family"))
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.concat_ws(" ", "p_name", "p_type").alias("item_content"), F.col("p_brand").alias("benchmark"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log before any join: row_id, ids, test_condition, response, trial."""
    condition = (
        F.when(F.col("o_orderpriority") == "5-LOW", "")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "null")
        .when(F.col("o_orderpriority") == "2-HIGH", "skill=high|source=web")
        .when(F.col("o_orderpriority") == "1-URGENT", "skill=urgent")
    )
    response = F.when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 2 == 0), F.col("l_quantity")).otherwise(F.col("l_discount") * 10)
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    row_id = F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "yyyyMMdd"))
    return lines.select(row_id.alias("row_id"), F.col("l_suppkey").cast("string").alias("subject_id"), F.col("l_partkey").cast("string").alias("item_id"), condition.alias("test_condition"), response.alias("response"), F.col("l_linenumber").alias("trial"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log joined to its registries; a missing subject or item leaves the id, or '', in place of a name or content."""
    return (
        raw(spark, sf_dir)
        .join(subjects(spark, sf_dir), "subject_id", "left")
        .join(items(spark, sf_dir), "item_id", "left")
        .withColumn("display_name", F.coalesce("display_name", "subject_id"))
        .withColumn("item_content", F.coalesce("item_content", F.lit("")))
        .withColumn("condition", normalize.condition(F.col("test_condition")))
    )


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """responses with stable keys and soft labels."""
    return normalize.soft_labels(keys.add_stable_keys(responses(spark, sf_dir)), "response", "benchmark")


def labelled(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """row_id, subject_id, item_id, benchmark, trial, test_condition and label, as keyed() has them, for queries that read nothing of subjects: an id has one row in its registry, so the join to theirs changes no row. more: columns of the items' registry."""
    it = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_brand").alias("benchmark"), *more)
    return normalize.soft_labels(raw(spark, sf_dir).join(it, "item_id", "left"), "response", "benchmark")


#: Common tables of the oracles: resp is keyed() but for the hashed keys.
RESPONSES = """
raw AS (SELECT concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::int, strftime(l_shipdate, '%Y%m%d')) AS row_id,
    l_suppkey::varchar AS subject_id, l_partkey::varchar AS item_id,
    CASE o_orderpriority WHEN '5-LOW' THEN '' WHEN '3-MEDIUM' THEN 'null' WHEN '2-HIGH' THEN 'skill=high|source=web' WHEN '1-URGENT' THEN 'skill=urgent' END AS test_condition,
    CASE WHEN l_returnflag = 'R' AND l_partkey % 2 = 0 THEN l_quantity ELSE l_discount * 10 END AS response, l_linenumber AS trial
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
subj AS (SELECT s_suppkey::varchar AS subject_id, s_name AS display_name, n_name AS organization, n_name AS family, r_name AS macro_family
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
it AS (SELECT p_partkey::varchar AS item_id, p_name || ' ' || p_type AS item_content, p_brand AS benchmark FROM part),
joined AS (SELECT row_id, subject_id, item_id, coalesce(display_name, subject_id) AS display_name, organization, family, macro_family, coalesce(item_content, '') AS item_content, benchmark,
    test_condition, CASE WHEN test_condition IS NULL OR test_condition = '' OR lower(test_condition) IN ('nan', 'none', 'null') THEN 'none' ELSE test_condition END AS condition, response, trial
  FROM raw LEFT JOIN subj USING (subject_id) LEFT JOIN it USING (item_id)),
resp AS (SELECT *, greatest(0, least(1, CASE WHEN response < 0 OR response > 1 THEN response / greatest(max(abs(response)) OVER (PARTITION BY benchmark), 1) ELSE response END)) AS label FROM joined)
"""


def oracle(sql: str, more: bool = False) -> str:
    """sql with the common tables before it; more: sql begins with further ones."""
    return f"WITH {RESPONSES.strip()}{'' if more else chr(10)}{sql}"

"""Lists of names made from the part table, in Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORG_B = """
SELECT p_partkey AS b_id, concat('REF', lpad(cast(p_partkey AS string), 6, '0')) AS b_ext_id,
  concat(p_name, ' ', p_brand, ' ', p_type, CASE p_partkey % 6 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' L.L.C.' WHEN 2 THEN ' Corp'
         WHEN 3 THEN ' Holdings GmbH' WHEN 4 THEN ', Ltd.' ELSE '' END) AS b_name FROM part"""
ORG_A = """
SELECT p_partkey AS a_id, CASE p_partkey % 12
  WHEN 0 THEN upper(concat(p_name, ' ', p_brand, ' ', p_type, ' incorporated'))
  WHEN 3 THEN concat('The ', p_name, ' & ', p_brand, ' ', p_type, ' llc')
  WHEN 6 THEN concat(p_name, ' ', p_brand)
  ELSE concat(p_name, ' Brand#', cast(p_size AS string), ' ', p_type, ' Co.') END AS a_name
FROM part WHERE p_partkey % 3 = 0"""
MANUAL = "SELECT a_id AS ordinal, a_id, a_name, concat('OVERRIDE ', cast(a_id AS string)) AS b_name, cast(NULL AS string) AS b_id FROM org_a WHERE a_id % 60 = 6"
TRUTH = "SELECT p_partkey AS a_id, p_partkey AS b_id FROM part WHERE p_partkey % 12 IN (0, 3)"
#: Decisions with known answers, so that what follows a decision can be held against SQL.
RESULTS = """
SELECT a_id AS ordinal, a_id, a_name, CASE WHEN a_id % 4 <> 1 AND a_id % 5 <> 0 THEN concat('B', cast(a_id % 50 AS string)) END AS b_name,
  CASE WHEN a_id % 4 <> 1 AND a_id % 5 <> 0 THEN cast(a_id % 50 AS string) END AS b_id,
  CASE a_id % 4 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'NO_MATCH' WHEN 2 THEN 'REVIEW' ELSE 'MATCH' END AS decision,
  cast((a_id * 37) % 1000 AS double) / 1000.0 AS score, CASE WHEN a_id % 3 = 0 THEN cast((a_id * 17) % 1000 AS double) / 1000.0 END AS runner_up_score,
  a_id % 7 AS group_size, a_id % 9 = 0 AS used_llm, CASE WHEN a_id % 8 = 0 THEN 1 ELSE 0 END AS label FROM org_a"""
RELATIONS = {"org_b": ORG_B, "org_a": ORG_A, "manual": MANUAL, "truth": TRUTH, "results": RESULTS}
WITH = "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in RELATIONS.items())


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation above over the part table of a folder."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    held = {"part": part}
    if name in ("manual", "results"):
        held["org_a"] = relation(spark, sf_dir, "org_a")
    text = RELATIONS[name]
    for k in held:
        text = text.replace(f"FROM {k}", f"FROM {{{k}}}")
    return spark.sql(text, **held)

"""What reviewers look at: matches by b, names to review, kinds of matches, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.functions.text import contains_folded


def groups_by_b(results: DataFrame, decision: str) -> DataFrame:
    """results (ordinal, a_name, b_name, b_id, decision, score): for each b named under a decision
    the first id and score, and its different names of a in order of appearance."""
    rows = results.where((F.col("decision") == decision) & F.col("b_name").isNotNull())
    firsts = rows.groupBy("b_name", "a_name").agg(F.min("ordinal").alias("ordinal"), F.min_by(F.struct("b_id", "score"), "ordinal").alias("own"))
    found = firsts.groupBy("b_name").agg(F.min_by("own", "ordinal").alias("own"), F.array_sort(F.collect_list(F.struct("ordinal", "a_name"))).alias("rows"))
    return found.select("b_name", F.col("own.b_id").alias("b_id"), F.coalesce("own.score", F.lit(0.0)).alias("score"), F.transform("rows", lambda r: r["a_name"]).alias("a_names"))


def review_names(results: DataFrame) -> DataFrame:
    """Names under review without a suggested b."""
    return results.where((F.col("decision") == "REVIEW") & F.col("b_name").isNull()).select("a_name").distinct()


def match_types(b: DataFrame, manual: DataFrame, results: DataFrame) -> DataFrame:
    """b with match_type: CM (manual) before AM (automatic) before RV (review), else null."""

    def flagged(rows: DataFrame, names: DataFrame, flag: str) -> DataFrame:
        return rows.join(names.where("b_name is not null").select("b_name").distinct().withColumn(flag, F.lit(True)), "b_name", "left")

    rows = flagged(b, manual, "_cm")
    rows = flagged(rows, results.where("decision = 'MATCH'"), "_am")
    rows = flagged(rows, results.where("decision = 'REVIEW'"), "_rv")
    kind = F.when(F.col("_cm"), "CM").when(F.col("_am"), "AM").when(F.col("_rv"), "RV")
    return rows.withColumn("match_type", kind).select(*b.columns, "match_type")


def with_type(typed: DataFrame, kind: str) -> DataFrame:
    """Of match_types: rows of one kind; NM are those without any."""
    return typed.where(F.col("match_type").isNull() if kind == "NM" else F.col("match_type") == kind)


def search(names: DataFrame, needle: str, name_col: str) -> DataFrame:
    return names.where(contains_folded(F.col(name_col), needle)) if needle else names


def listed_first(names: DataFrame, relevant: DataFrame, name_col: str, position: str) -> DataFrame:
    """names with relevant ones first, each part in its order: (.., relevant, place)."""
    flag = names.join(relevant.select(F.col(name_col)).distinct().withColumn("relevant", F.lit(True)), name_col, "left")
    return flag.withColumn("relevant", F.coalesce("relevant", F.lit(False))).orderBy(F.desc("relevant"), position)


def display(results: DataFrame, decision: str = "MATCH") -> DataFrame:
    """Rows of a decision with the columns that are shown."""
    more = ["group_size"] if "group_size" in results.columns else []
    return results.where(F.col("decision") == decision).select("a_name", *more, "b_name", "b_id", "score")

"""Precision, recall and reasons of false positives against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _metrics(tp: Column, fp: Column, fn: Column, tn: Column, rows: DataFrame, more: dict[str, Column]) -> DataFrame:
    out = rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in (("tp", tp), ("fp", fp), ("fn", fn), ("tn", tn))], *[c.alias(n) for n, c in more.items()])
    share = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(x) + F.col(y)), F.lit(0.0))
    out = out.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def evaluate_pairs(predictions: DataFrame) -> DataFrame:
    """predictions (label 0/1, decision, used_llm) -> one row of counts and ratios."""
    said, true = F.col("decision") == "MATCH", F.col("label") == 1
    more = {"ambiguous": F.count_if(F.col("decision") == "REVIEW"), "llm_calls": F.count_if(F.col("used_llm"))}
    return _metrics(said & true, said & ~true, ~said & true, ~said & ~true, predictions, more)


def evaluate_lists(results: DataFrame, truth: DataFrame) -> DataFrame:
    """results (a_id, b_id, decision, used_llm) against truth (a_id, b_id).

    A match to the wrong b is a false positive and not also a false negative."""
    rows = results.join(truth.select("a_id", F.col("b_id").alias("true_b")), "a_id", "left")
    said, has = F.col("decision") == "MATCH", F.col("true_b").isNotNull()
    right = said & has & (F.col("b_id") == F.col("true_b"))
    more = {"ambiguous": F.count_if(F.col("decision") == "REVIEW"), "llm_calls": F.count_if(F.col("used_llm"))}
    return _metrics(F.coalesce(right, F.lit(False)), said & ~F.coalesce(right, F.lit(False)), ~said & has, ~said & ~has, rows, more)


def false_positive_reasons(rows: DataFrame) -> DataFrame:
    """rows (label, decision, reasons): how often each reason stands on a false positive."""
    wrong = rows.where((F.col("decision") == "MATCH") & (F.col("label") != 1))
    return wrong.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def decision_summary(results: DataFrame, weight: str | None = None) -> DataFrame:
    total = F.sum(weight) if weight else F.count("*")
    return results.groupBy("decision").agg(total.cast("long").alias("n"))


def matcher_stats(results: DataFrame, b: DataFrame) -> DataFrame:
    """One row: a_count, b_count, comparisons, no_candidates, llm_used."""
    mine = results.agg(F.count("*").alias("a_count"), F.sum("candidate_count").cast("long").alias("comparisons"), F.count_if(F.col("candidate_count") == 0).alias("no_candidates"), F.count_if("used_llm").alias("llm_used"))
    return mine.crossJoin(b.agg(F.count("*").alias("b_count")))


def run_stats(results: DataFrame, embedding: dict[str, int] | None = None) -> DataFrame:
    """One row: how many names each decision has, how many the judge overrode to a match or none, and
    the calls and cache hits of embedding."""
    counts = [F.count_if(F.col("decision") == d).alias(f"n_{d.lower()}") for d in ("MATCH", "NO_MATCH", "REVIEW")]
    over = F.count_if(F.col("used_llm") & F.col("decision").isin("MATCH", "NO_MATCH")).alias("llm_overrides")
    held = embedding or {}
    return results.agg(*counts, over, *[F.max(F.lit(held.get(k, 0))).cast("long").alias(f"embedding_{k}") for k in ("api_calls", "cache_hits")])

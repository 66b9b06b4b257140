"""Duplicates within a list, groups of equal names, and cleaned variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.functions.text import any_contains
from namewright.operators.normalize import normalize, tokenized, with_core
from namewright.plans.config import Config
from namewright.plans.lexicon import Lexicon


def grouped(names: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """Each name once, with the first id that has it and how many rows do."""
    return names.where(F.col(name_col).isNotNull()).groupBy(name_col).agg(F.min(id_col).alias("first_id"), F.count("*").alias("group_size"))


def exact_duplicates(names: DataFrame, name_col: str = "name") -> DataFrame:
    return names.where(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_totals(names: DataFrame, name_col: str = "name") -> DataFrame:
    return exact_duplicates(names, name_col).agg(F.count("*").alias("names"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"))


def normalized_duplicates(names: DataFrame, config: Config = Config(), lexicon: Lexicon = Lexicon(), name_col: str = "name") -> DataFrame:
    """Cores that more than one row has, with the names that have them and how often.

    Names are counted first, so a core's list has as many entries as it has different names."""
    counted = names.where(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("name")).agg(F.count("*").alias("n"))
    cores = normalize(counted, config, lexicon).select("core_string", "name", "n")
    found = cores.groupBy("core_string").agg(F.sum("n").cast("long").alias("total"), F.array_sort(F.collect_list(F.struct("name", "n"))).alias("originals"))
    return found.where("total > 1")


def cleaned(names: DataFrame, lexicon: Lexicon = Lexicon(), name_col: str = "name") -> DataFrame:
    """original, normalized, no_<category> for each further category, and no_all.

    Tokens are made once and shared by all variants."""
    others = [c for c in lexicon.category_names() if c != "stopwords"]
    rows = tokenized(names, lexicon, name_col)
    base = Config()
    variants = {"normalized": base} | {f"no_{c}": base.stripping(c) for c in others}
    if others:
        variants["no_all"] = Config(strip_categories=tuple(lexicon.category_names()))
    for label, config in variants.items():
        rows = with_core(rows, config, lexicon, "v_").withColumn(label, F.array_join("v_core_tokens", " "))
    return rows.select(F.col(name_col).alias("original"), *variants)


def filtered(rows: DataFrame, needle: str) -> DataFrame:
    """Rows of which any cell contains the needle, whatever the case."""
    return rows.where(any_contains([F.col(c) for c in rows.columns], needle))

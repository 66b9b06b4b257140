"""Normalization of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.functions import text as T
from namewright.plans.config import Config
from namewright.plans.lexicon import Lexicon

KEY_TYPES = ("k_core", "k_prefix2", "k_prefix3", "k_acronym", "k_first")


def tokenized(names: DataFrame, lexicon: Lexicon = Lexicon(), name_col: str = "name") -> DataFrame:
    """names with normalized_text and raw_tokens; rows whose name is null go."""
    rows = names.where(F.col(name_col).isNotNull()).withColumn("normalized_text", T.replaced(T.fold(F.col(name_col)), lexicon.replacements))
    return rows.withColumn("raw_tokens", T.canonical(T.split_words(F.col("normalized_text")), lexicon.aliases))


def with_core(rows: DataFrame, config: Config = Config(), lexicon: Lexicon = Lexicon(), prefix: str = "") -> DataFrame:
    """rows with raw_tokens -> with core_tokens, removed_designators and removed_words.

    Designators off the end, then words of categories, then designators again down to one token: one
    pass is a fixed point, for after it no word of a category is left or all tokens are such words.
    """
    designators, words = list(lexicon.designators), lexicon.words(*config.strip_categories)
    first = T.strip_designators(F.col("raw_tokens"), designators, 2, config.strip_prefix_designators)
    rows = rows.withColumn("_one", first)
    if config.strip_categories:
        rows = rows.withColumn("_two", T.strip_words(F.col("_one.core"), words))
        rows = rows.withColumn("_three", T.strip_designators(F.col("_two.core"), designators, 1, config.strip_prefix_designators))
    else:
        none = F.array().cast("array<string>")
        rows = rows.withColumn("_two", F.struct(F.col("_one.core").alias("core"), none.alias("removed"))).withColumn("_three", F.col("_two"))
    removed = F.concat(F.col("_one.removed"), F.col("_three.removed")) if config.strip_categories else F.col("_one.removed")
    made = {f"{prefix}core_tokens": F.col("_three.core"), f"{prefix}removed_designators": removed, f"{prefix}removed_words": F.col("_two.removed")}
    return rows.withColumns(made).drop("_one", "_two", "_three")


def normalize(names: DataFrame, config: Config = Config(), lexicon: Lexicon = Lexicon(), name_col: str = "name") -> DataFrame:
    """names with the whole normalized record appended."""
    rows = with_core(tokenized(names, lexicon, name_col), config, lexicon)
    core = F.col("core_tokens")
    rows = rows.withColumns({"core_string": F.array_join(core, " "), "acronym": T.acronym(F.col(name_col), core, config.acronym_min_length), "numeric_tokens": T.numeric_tokens(core)})
    warnings = F.array_compact(F.array(
        F.when(F.size(core) == 1, F.lit("single_token_core")),
        F.when(F.lower("acronym").isin(list(lexicon.collisions)), F.lit("collision_acronym")),
    ))
    return rows.withColumns({"warnings": warnings, "keys": keys(config)})


def normalize_once(names: DataFrame, config: Config = Config(), lexicon: Lexicon = Lexicon(), name_col: str = "name") -> DataFrame:
    """normalize, with each distinct name normalized once; also spreads a list that lies in few files."""
    once = normalize(names.select(name_col).where(F.col(name_col).isNotNull()).distinct(), config, lexicon, name_col)
    return names.join(once.hint("merge"), name_col).select(*names.columns, *[c for c in once.columns if c != name_col])


def keys(config: Config = Config()):
    """Array of (type, value): the blocking keys of a normalized row."""
    core = F.col("core_tokens")
    pair = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    prefix = lambda n: F.array_join(F.slice(core, 1, n), " ")
    found = [
        pair("k_core", F.col("core_string")), F.when(F.size(core) >= 2, pair("k_prefix2", prefix(2))), F.when(F.size(core) >= 3, pair("k_prefix3", prefix(3))),
        F.when(F.col("acronym").isNotNull(), pair("k_acronym", F.col("acronym"))),
    ]
    if config.candidates.use_k_first:
        found.append(F.when(F.size(core) >= 1, pair("k_first", F.get(core, 0))))
    return F.array_compact(F.array(*found))

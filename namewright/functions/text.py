"""Column functions on names and tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What Python's str.split takes for white space.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def members(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


@F.pandas_udf(StringType())
def _compatible_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def fold(name: Column) -> Column:
    """NFKC and casefold; ASCII names never leave the JVM's side of the work."""
    ascii_only = name.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, F.lower(name)).otherwise(_compatible_casefold(F.when(~ascii_only, name)))


def replaced(text: Column, replacements: dict[str, str]) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), replacements.items(), text)


def stripped(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, f"^{WHITE}|{WHITE}$", "")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda t: t != "")


def canonical(tokens: Column, aliases: dict[str, str]) -> Column:
    """Aliases of raw tokens; other tokens lose punctuation, and go if nothing is left."""
    plain = lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_]", "")
    changed = {k: v for k, v in aliases.items() if k != v}
    if not changed:
        return F.filter(F.transform(tokens, plain), lambda t: t != "")
    table = F.create_map(*[F.lit(x) for kv in changed.items() for x in kv])
    return F.filter(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), plain(t))), lambda t: t != "")


def _kept_range(tokens: Column, words: list[str], prefix: bool) -> Column:
    """(from, to): 0-based start and end of what stripping designators leaves."""
    held = members(words)
    to = F.coalesce(F.array_max(F.transform(tokens, lambda t, i: F.when(F.array_contains(held, t), 0).otherwise(i + 1))), F.lit(0))
    start = F.coalesce(F.array_min(F.transform(tokens, lambda t, i: F.when(F.array_contains(held, t), F.size(tokens)).otherwise(i))), F.lit(0)) if prefix else F.lit(0)
    return F.struct(start.cast("int").alias("a"), to.cast("int").alias("b"))


def strip_designators(tokens: Column, words: list[str], min_tokens: int = 2, prefix: bool = False) -> Column:
    """struct(core, removed): a run of designators off the end (and the front); all stay if fewer
    than min_tokens tokens would be left."""

    def cut(own: Column, r: Column) -> Column:
        size = F.greatest(r["b"] - r["a"], F.lit(0))
        removed = F.filter(own, lambda t, i: (i < r["a"]) | (i >= r["b"]))
        none = F.array().cast("array<string>")
        return F.struct(F.when(size < min_tokens, own).otherwise(F.slice(own, r["a"] + 1, size)).alias("core"), F.when(size < min_tokens, none).otherwise(removed).alias("removed"))

    return let(tokens, lambda own: let(_kept_range(own, words, prefix), lambda r: cut(own, r)))


def strip_words(tokens: Column, words: list[str]) -> Column:
    """struct(core, removed): words taken out anywhere; all stay if none would be left."""
    held, none = members(words), F.array().cast("array<string>")

    def cut(own: Column, kept: Column) -> Column:
        gone = F.filter(own, lambda t: F.array_contains(held, t))
        return F.struct(F.when(F.size(kept) == 0, own).otherwise(kept).alias("core"), F.when(F.size(kept) == 0, none).otherwise(gone).alias("removed"))

    return let(tokens, lambda own: let(F.filter(own, lambda t: ~F.array_contains(held, t)), lambda kept: cut(own, kept)))


def numeric_tokens(tokens: Column) -> Column:
    return F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit(r"(\p{Nd}+)"), F.lit(1))))


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def acronym(original: Column, core: Column, min_length: int = 3) -> Column:
    """As typed (I.B.M.), else initials of min_length tokens or more, else an upper-case single word."""
    parts = F.filter(F.split(stripped(original), r"[.\s]+"), lambda p: p != "")
    joined = F.array_join(parts, "")
    typed = F.when(F.forall(parts, lambda p: F.char_length(p) == 1) & joined.rlike(r"^\p{L}{3,}$"), F.lower(joined))
    made = F.when(F.size(core) >= min_length, initials(core))
    shown = F.replace(stripped(original), F.lit("."), F.lit(""))
    only = F.get(core, 0)
    upper = shown.rlike(r"\p{Lu}") & ~shown.rlike(r"[\p{Ll}\p{Lt}]")
    single = F.when((F.size(core) == 1) & only.rlike(rf"^\p{{L}}{{{min_length},}}$") & upper, only)
    return F.coalesce(typed, made, single)


def acronym_relation(a: Column, a_initials: Column, b: Column, b_initials: Column, collisions: Iterable[str]) -> Column:
    """exact, initialism, collision or none, in this order of tests; initials are of cores of three
    tokens or more, else null."""
    clash = lambda c: F.lower(c).isin(list(collisions))
    return (
        F.when(a == b, F.when(clash(a), "collision").otherwise("exact"))
        .when(a == b_initials, F.when(clash(a), "collision").otherwise("initialism"))
        .when(b == a_initials, F.when(clash(b), "collision").otherwise("initialism"))
        .otherwise("none")
    )


def contains_folded(name: Column, needle: str) -> Column:
    """Whether a needle is in a name, whatever the case; no pattern characters."""
    return F.lower(name).contains(needle.lower())


def any_contains(columns: Iterable[Column], needle: str) -> Column:
    return reduce(lambda x, y: x | y, [F.coalesce(contains_folded(c.cast("string"), needle), F.lit(False)) for c in columns])


def pair_key(a_core: Column, b_core: Column) -> Column:
    return F.concat(F.substring(F.sha2(a_core, 256), 1, 16), F.lit("::"), F.substring(F.sha2(b_core, 256), 1, 16))

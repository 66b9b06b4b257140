"""Registered queries, one or more for each operator, and the SQL that tells the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.functions import text as T
from namewright.functions.similarity import cosine, fuzzy
from namewright.operators import arbiter, blocking, decide, evaluate, overrides, quality, review, scoring, vectors
from namewright.operators.normalize import normalize, normalize_once
from namewright.plans import linker
from namewright.plans.config import Arbitration, Config
from namewright.plans.lexicon import ACRONYM_COLLISION, ALIASES, BRANCH, DESIGNATORS, INSTITUTION, LOCATION, STOPWORDS
from namewright.plans.relations import WITH, relation
from namewright.plans.session import ship
from namewright.sources.names import csv_rows, export_rows

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name with its SQL, which may use the relations and NORM parts."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        FOUND[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- SQL of normalization ------------------------------------------------------------------------


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _strip(tokens: str, least: int) -> tuple[str, str]:
    keep = f"coalesce(list_max(list_transform(range(1, len({tokens}) + 1), lambda i: CASE WHEN list_contains({_list(DESIGNATORS)}, {tokens}[i]) THEN 0 ELSE i END)), 0)"
    return f"CASE WHEN {keep} < {least} THEN {tokens} ELSE {tokens}[1:{keep}] END", f"CASE WHEN {keep} < {least} THEN []::VARCHAR[] ELSE {tokens}[{keep} + 1:] END"


def _alias(x: str) -> str:
    return "CASE " + x + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items()) + f" ELSE regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', '', 'g') END"


def norm(name: str, source: str, key: str, text: str, words: list[str] = STOPWORDS, low: str = "lower({})") -> str:
    """CTEs that normalize source(key, text) step by step; the last is called `name`."""
    first, gone1 = _strip("raw_tokens", 2)
    third, gone3 = _strip("two", 1)
    w = _list(words)
    return f""",
{name}_1 AS (SELECT {key} AS id, {text} AS name, list_filter(string_split_regex(replace(replace({low.format(text)}, '&', ' and '), '+', ' and '), '\\s+'), lambda x: x <> '') AS parts FROM {source} WHERE {text} IS NOT NULL),
{name}_2 AS (SELECT id, name, list_filter(list_transform(parts, lambda x: {_alias('x')}), lambda x: x <> '') AS raw_tokens FROM {name}_1),
{name}_3 AS (SELECT *, {first} AS one, {gone1} AS gone1 FROM {name}_2),
{name}_4 AS (SELECT *, CASE WHEN len(list_filter(one, lambda x: NOT list_contains({w}, x))) = 0 THEN one ELSE list_filter(one, lambda x: NOT list_contains({w}, x)) END AS two,
  CASE WHEN len(list_filter(one, lambda x: NOT list_contains({w}, x))) = 0 THEN []::VARCHAR[] ELSE list_filter(one, lambda x: list_contains({w}, x)) END AS removed_words FROM {name}_3),
{name}_5 AS (SELECT *, {third} AS core, list_concat(gone1, {gone3}) AS removed_designators FROM {name}_4),
{name} AS (SELECT id, name, raw_tokens, core, removed_words, removed_designators, array_to_string(core, ' ') AS core_string,
  list_filter(flatten(list_transform(core, lambda x: regexp_extract_all(x, '\\d+'))), lambda x: x <> '') AS numbers,
  coalesce(
    CASE WHEN len(list_filter(string_split_regex(trim(name), '[.\\s]+'), lambda x: len(x) > 1)) = 0 AND regexp_full_match(regexp_replace(trim(name), '[.\\s]+', '', 'g'), '\\p{{L}}{{3,}}') THEN lower(regexp_replace(trim(name), '[.\\s]+', '', 'g')) END,
    CASE WHEN len(core) >= 3 THEN array_to_string(list_transform(core, lambda x: x[1]), '') END,
    CASE WHEN len(core) = 1 AND regexp_full_match(core[1], '\\p{{L}}{{3,}}') AND regexp_matches(name, '\\p{{Lu}}') AND NOT regexp_matches(name, '\\p{{Ll}}') THEN core[1] END) AS acronym FROM {name}_5)"""


NB, NA = norm("nb", "org_b", "b_id", "b_name"), norm("na", "org_a", "a_id", "a_name")
KEYS = """,
{0}k AS (SELECT id, 'k_core' AS key_type, core_string AS key_value FROM {0} UNION ALL SELECT id, 'k_prefix2', array_to_string(core[1:2], ' ') FROM {0} WHERE len(core) >= 2
  UNION ALL SELECT id, 'k_prefix3', array_to_string(core[1:3], ' ') FROM {0} WHERE len(core) >= 3 UNION ALL SELECT id, 'k_acronym', acronym FROM {0} WHERE acronym IS NOT NULL
  UNION ALL SELECT id, 'k_first', core[1] FROM {0} WHERE len(core) >= 1)"""
BOTH = WITH + NA + NB + KEYS.format("na") + KEYS.format("nb")
PAIRS = """,
pairs AS (SELECT a.id AS a_id, b.id AS b_id, list_sort(list(DISTINCT a.key_type)) AS sources, count(*) AS n,
  min(CASE a.key_type WHEN 'k_core' THEN 0 WHEN 'k_prefix2' THEN 1 WHEN 'k_prefix3' THEN 2 WHEN 'k_acronym' THEN 3 ELSE 4 END) AS kind
  FROM nak a JOIN nbk b ON a.key_type = b.key_type AND a.key_value = b.key_value GROUP BY a.id, b.id)"""
CAPPED = PAIRS + ",\ncapped AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY n DESC, kind, b_id) <= 300)"
JOINED = CAPPED + """,
ends AS (SELECT c.a_id, c.b_id, a.core AS ac, b.core AS bc, a.acronym AS aa, b.acronym AS ba, list_sort(list_distinct(a.numbers)) AS an, list_sort(list_distinct(b.numbers)) AS bn,
  list_filter(a.core, lambda x: NOT list_contains({d}, x)) AS ax, list_filter(b.core, lambda x: NOT list_contains({d}, x)) AS bx FROM capped c JOIN na a ON a.id = c.a_id JOIN nb b ON b.id = c.b_id),
eff AS (SELECT *, CASE WHEN len(ax) = 0 THEN ac ELSE ax END AS ae, CASE WHEN len(bx) = 0 THEN bc ELSE bx END AS be FROM ends),
rel AS (SELECT *, CASE WHEN least(len(list_distinct(ae)), len(list_distinct(be))) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(ae), list_distinct(be)))::DOUBLE / least(len(list_distinct(ae)), len(list_distinct(be))) END AS token_overlap,
  CASE WHEN aa = ba THEN CASE WHEN list_contains({x}, aa) THEN 'collision' ELSE 'exact' END
    WHEN aa IS NOT NULL AND len(bc) >= 3 AND aa = array_to_string(list_transform(bc, lambda x: x[1]), '') THEN CASE WHEN list_contains({x}, aa) THEN 'collision' ELSE 'initialism' END
    WHEN ba IS NOT NULL AND len(ac) >= 3 AND ba = array_to_string(list_transform(ac, lambda x: x[1]), '') THEN CASE WHEN list_contains({x}, ba) THEN 'collision' ELSE 'initialism' END ELSE 'none' END AS relation,
  CASE WHEN len(an) > 0 AND len(bn) > 0 THEN CASE WHEN an = bn THEN 0.0 ELSE 0.3 END WHEN len(an) > 0 OR len(bn) > 0 THEN 0.1 ELSE 0.0 END::DOUBLE AS penalty FROM eff)""".format(d=_list(DESIGNATORS), x=_list(ACRONYM_COLLISION))


def org(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return relation(spark, sf_dir, f"org_{side}")


def normalized(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return normalize(org(spark, sf_dir, side), Config(), name_col=f"{side}_name")


def capped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [normalized(spark, sf_dir, s) for s in "ab"]
    return blocking.merge_candidates(blocking.best_candidates(*sides, Config().candidates.max_lexical), None)


def sided_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = capped_pairs(spark, sf_dir)
    for s in "ab":
        out = out.join(scoring.side(normalized(spark, sf_dir, s), f"{s}_id", f"{s}_"), f"{s}_id")
    return out


# --- normalization -------------------------------------------------------------------------------


@query(WITH + NB + " SELECT id AS b_id, array_to_string(raw_tokens, ' ') AS tokens, len(raw_tokens) AS n FROM nb")
def norm_tokens_b(spark, sf_dir):
    return normalized(spark, sf_dir, "b").select("b_id", F.array_join("raw_tokens", " ").alias("tokens"), F.size("raw_tokens").cast("long").alias("n"))


@query(WITH + NB + " SELECT id AS b_id, core_string, len(core) AS n FROM nb")
def norm_core_b(spark, sf_dir):
    return normalized(spark, sf_dir, "b").select("b_id", "core_string", F.size("core_tokens").cast("long").alias("n"))


@query(WITH + NA + " SELECT id AS a_id, core_string, len(core) AS n FROM na")
def norm_core_a(spark, sf_dir):
    return normalized(spark, sf_dir, "a").select("a_id", "core_string", F.size("core_tokens").cast("long").alias("n"))


@query(WITH + NB + " SELECT id AS b_id, array_to_string(removed_designators, ' ') AS removed FROM nb")
def norm_removed_designators(spark, sf_dir):
    return normalized(spark, sf_dir, "b").select("b_id", F.array_join("removed_designators", " ").alias("removed"))


@query(WITH + NA + " SELECT id AS a_id, array_to_string(removed_words, ' ') AS removed FROM na")
def norm_removed_categories(spark, sf_dir):
    return normalized(spark, sf_dir, "a").select("a_id", F.array_join("removed_words", " ").alias("removed"))


CUSTOMERS = "SELECT c_custkey AS b_id, c_name AS b_name FROM customer UNION ALL SELECT -s_suppkey, s_name FROM supplier"


def _customers(spark, sf_dir):
    c, s = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "supplier"))
    return c.select(F.col("c_custkey").alias("b_id"), F.col("c_name").alias("b_name")).unionByName(s.select((-F.col("s_suppkey")).alias("b_id"), F.col("s_name").alias("b_name")))


@query("WITH org AS (" + CUSTOMERS + ")" + norm("n", "org", "b_id", "b_name") + f" SELECT id AS b_id, core_string, array_to_string(numbers, ' ') AS numbers, concat_ws('|', CASE WHEN len(core) = 1 THEN 'single_token_core' END, CASE WHEN list_contains({_list(ACRONYM_COLLISION)}, acronym) THEN 'collision_acronym' END) AS warnings FROM n")
def norm_warnings(spark, sf_dir):
    rows = normalize(_customers(spark, sf_dir), Config(), name_col="b_name")
    return rows.select("b_id", "core_string", F.array_join("numeric_tokens", " ").alias("numbers"), F.array_join("warnings", "|").alias("warnings"))


@query("WITH org AS (SELECT doc_id, text FROM documents)" + norm("n", "org", "doc_id", "text", low="replace(lower({}), 'ß', 'ss')") + " SELECT id AS doc_id, len(raw_tokens) AS n, sha256(core_string) AS core_sha256 FROM n")
def norm_core_docs(spark, sf_dir):
    rows = normalize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Config(), name_col="text")
    return rows.select("doc_id", F.size("raw_tokens").cast("long").alias("n"), F.sha2("core_string", 256).alias("core_sha256"))


@query(WITH + NB + " SELECT id AS b_id, array_to_string(numbers, ' ') AS numbers FROM nb")
def numeric_tokens(spark, sf_dir):
    return normalized(spark, sf_dir, "b").select("b_id", F.array_join("numeric_tokens", " ").alias("numbers"))


@query(WITH + NB + " SELECT id AS b_id, acronym FROM nb")
def acronyms(spark, sf_dir):
    return normalized(spark, sf_dir, "b").select("b_id", "acronym")


# --- blocking ------------------------------------------------------------------------------------


@query(BOTH + " SELECT id AS b_id, key_type, key_value FROM nbk")
def blocking_keys(spark, sf_dir):
    return blocking.key_table(normalized(spark, sf_dir, "b"), "b_id")


@query(BOTH + PAIRS + " SELECT a_id, b_id, array_to_string(sources, ',') AS sources FROM pairs")
def lexical_candidates(spark, sf_dir):
    sources = lambda shared: blocking.named(shared, lambda names: F.lit(",".join(names))).alias("sources")
    return blocking.lexical_pairs(*[normalize_once(org(spark, sf_dir, s), Config(), name_col=f"{s}_name") for s in "ab"], sources)


@query(BOTH + CAPPED + " SELECT a_id, b_id, array_to_string(sources, ',') AS sources FROM capped")
def candidates_capped(spark, sf_dir):
    return capped_pairs(spark, sf_dir).select("a_id", "b_id", F.array_join("sources", ",").alias("sources"))


@query(BOTH + CAPPED + " SELECT a_id, count(*) AS candidate_count FROM capped GROUP BY a_id")
def candidate_counts(spark, sf_dir):
    return blocking.candidate_counts(capped_pairs(spark, sf_dir))


@query(BOTH + CAPPED + """, near AS (SELECT a.a_id, b.b_id FROM org_a a JOIN org_b b ON b.b_id BETWEEN a.a_id AND a.a_id + 4),
every AS (SELECT a_id, b_id, unnest(sources) AS s FROM capped UNION ALL SELECT a_id, b_id, 'embedding' FROM near)
SELECT a_id, b_id, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM every GROUP BY a_id, b_id""")
def candidate_union(spark, sf_dir):
    """Lexical candidates together with neighbors, here those of the next five ids."""
    a, b = org(spark, sf_dir, "a").select("a_id"), org(spark, sf_dir, "b").select("b_id")
    near = a.select("a_id", F.explode(F.sequence(F.col("a_id"), F.col("a_id") + 4)).alias("b_id")).join(b, "b_id")
    near = near.withColumn("rank", (F.col("b_id") - F.col("a_id") + 1).cast("int"))
    sides = [normalized(spark, sf_dir, s) for s in "ab"]
    merged = blocking.merge_candidates(blocking.best_candidates(*sides, Config().candidates.max_lexical), near)
    return merged.select("a_id", "b_id", F.array_join("sources", ",").alias("sources"))


# --- scoring -------------------------------------------------------------------------------------


@query(BOTH + JOINED + " SELECT a_id, b_id, relation FROM rel")
def acronym_relation_pairs(spark, sf_dir):
    return scoring.features(sided_pairs(spark, sf_dir), with_fuzzy=False).select("a_id", "b_id", F.col("acronym_relation").alias("relation"))


@query(BOTH + JOINED + " SELECT a_id, b_id, round(token_overlap, 4) AS token_overlap FROM rel")
def token_overlap(spark, sf_dir):
    return scoring.features(sided_pairs(spark, sf_dir), with_fuzzy=False).select("a_id", "b_id", F.round("token_overlap", 4).alias("token_overlap"))


@query(BOTH + JOINED + " SELECT a_id, b_id, penalty FROM rel")
def numeric_penalty(spark, sf_dir):
    return scoring.features(sided_pairs(spark, sf_dir), with_fuzzy=False).select("a_id", "b_id", F.col("numeric_penalty").alias("penalty"))


FIXED = JOINED + """,
told AS (SELECT *, CASE relation WHEN 'exact' THEN 1.0 WHEN 'initialism' THEN 0.9 WHEN 'collision' THEN 0.3 ELSE 0.0 END::DOUBLE AS acr, ((a_id * 7 + b_id * 13) % 101)::DOUBLE / 100 AS fz,
  CASE WHEN b_id % 3 = 0 THEN ((a_id + b_id) % 21)::DOUBLE / 20 - 0.05 END AS cosine FROM rel),
lex AS (SELECT *, greatest(0, coalesce(cosine, 0)) AS sem, 0.35::DOUBLE * token_overlap + 0.3::DOUBLE * fz + 0.2::DOUBLE * acr AS top, 0.65::DOUBLE + CASE WHEN acr > 0 THEN 0.2 ELSE 0 END::DOUBLE AS under FROM told),
raw AS (SELECT *, top / under - penalty AS plain, greatest(0.0, least(1.0, (top + 0.15::DOUBLE * sem) / (under + CASE WHEN sem > 0 THEN 0.15 ELSE 0 END::DOUBLE) - penalty)) AS full_score FROM lex),
scored AS (SELECT *, cosine IS NOT NULL AND plain < 0.92 AND full_score >= 0.92 AS capped FROM raw)"""


@query(BOTH + FIXED + """ SELECT a_id, b_id, round(CASE WHEN capped THEN 0.91 ELSE full_score END, 6) AS score,
concat_ws('|', CASE WHEN token_overlap >= 0.8 THEN 'core_overlap_high' END, CASE WHEN fz >= 0.85 THEN 'fuzzy_high' END, CASE WHEN relation IN ('exact', 'initialism') THEN 'acronym_match_strong' END,
 CASE WHEN relation = 'collision' THEN 'acronym_match_weak' END, CASE WHEN penalty = 0.3 THEN 'numeric_mismatch' WHEN penalty = 0.1 THEN 'numeric_one_side_only' END,
 CASE WHEN sem >= 0.85 THEN 'semantic_boost' END, CASE WHEN capped THEN 'semantic_capped' END) AS reasons FROM scored""")
def score_given_fuzzy(spark, sf_dir):
    """All of scoring, with stand-ins for the fuzzy ratio and the cosine."""
    rows = sided_pairs(spark, sf_dir).withColumn("cosine", F.when(F.col("b_id") % 3 == 0, ((F.col("a_id") + F.col("b_id")) % 21).cast("double") / 20 - 0.05))
    rows = scoring.features(rows, with_fuzzy=False).withColumn("fuzzy_similarity", ((F.col("a_id") * 7 + F.col("b_id") * 13) % 101).cast("double") / 100)
    return scoring.score(rows).select("a_id", "b_id", F.round("score", 6).alias("score"), F.array_join("reasons", "|").alias("reasons"))


@query()
def fuzzy_scores(spark, sf_dir):
    rows = scoring.features(sided_pairs(spark, sf_dir)).select(F.array_join("a_effective", " ").alias("a"), F.array_join("b_effective", " ").alias("b")).distinct()
    return rows.select("a", "b", F.round(fuzzy("a", "b"), 6).alias("fuzzy"))


# --- linking -------------------------------------------------------------------------------------


@query(BOTH + """, cores AS (SELECT core_string, count(*) AS n, min(id) AS b_id FROM nb GROUP BY core_string)
SELECT na.id AS a_id, CASE WHEN n = 1 THEN cores.b_id END AS b_id, CASE WHEN n = 1 THEN 'MATCH' ELSE 'REVIEW' END AS decision, n AS same_core FROM na JOIN cores USING (core_string)""")
def link_exact_core(spark, sf_dir):
    """The smallest useful link: equal cores; a core that several b have is for review."""
    cores = normalized(spark, sf_dir, "b").groupBy("core_string").agg(F.count("*").alias("same_core"), F.min("b_id").alias("only"))
    rows = normalized(spark, sf_dir, "a").join(cores, "core_string")
    one = F.col("same_core") == 1
    return rows.select("a_id", F.when(one, F.col("only")).alias("b_id"), F.when(one, "MATCH").otherwise("REVIEW").alias("decision"), "same_core")


@query()
def link_full(spark, sf_dir):
    found = linker.Linker().prepare(org(spark, sf_dir, "b")).link(org(spark, sf_dir, "a"))
    return found.select("a_id", "a_name", "b_id", "b_name", "b_ext_id", "decision", F.round("score", 4).alias("score"), F.round("runner_up_score", 4).alias("runner_up_score"), F.array_join("reasons", "|").alias("reasons"), "candidate_count")


@query()
def link_with_overrides(spark, sf_dir):
    manual = relation(spark, sf_dir, "manual")
    found = linker.Linker().prepare(org(spark, sf_dir, "b").withColumn("b_id", F.col("b_id").cast("string"))).link(org(spark, sf_dir, "a"), manual)
    return found.select("a_id", "a_name", "b_id", "b_name", "decision", F.round("score", 4).alias("score"), F.array_join("reasons", "|").alias("reasons"))


@query(BOTH + FIXED + """, ranked AS (SELECT s.a_id, s.b_id, CASE WHEN s.capped THEN 0.91 ELSE s.full_score END AS score, row_number() OVER w AS rn, lead(CASE WHEN s.capped THEN 0.91 ELSE s.full_score END) OVER w AS runner
  FROM scored s JOIN pairs p USING (a_id, b_id) WINDOW w AS (PARTITION BY s.a_id ORDER BY round(CASE WHEN s.capped THEN 0.91 ELSE s.full_score END, 6) DESC, p.n DESC, p.kind, s.b_id))
SELECT a_id, b_id, round(score, 6) AS score, round(runner, 6) AS runner_up_score, CASE WHEN score <= 0.75 THEN 'NO_MATCH' WHEN score >= 0.92 AND (runner IS NULL OR score - runner >= 0.06) THEN 'MATCH' ELSE 'REVIEW' END AS decision FROM ranked WHERE rn = 1""")
def decision_bands(spark, sf_dir):
    rows = sided_pairs(spark, sf_dir).withColumn("cosine", F.when(F.col("b_id") % 3 == 0, ((F.col("a_id") + F.col("b_id")) % 21).cast("double") / 20 - 0.05))
    rows = scoring.features(rows, with_fuzzy=False).withColumn("fuzzy_similarity", ((F.col("a_id") * 7 + F.col("b_id") * 13) % 101).cast("double") / 100)
    rows = decide.ranked(scoring.score(rows).withColumn("score", F.round("score", 6))).where("rank = 1")
    return rows.select("a_id", "b_id", F.round("score", 6).alias("score"), F.round("runner_up_score", 6).alias("runner_up_score"), decide.band(F.col("score"), F.col("margin")).alias("decision"))


# --- overrides -----------------------------------------------------------------------------------


@query(WITH + " SELECT a_id, a_name, a_name IN (SELECT a_name FROM manual) AS overridden FROM org_a")
def override_split(spark, sf_dir):
    held, rest = overrides.split_overrides(org(spark, sf_dir, "a"), relation(spark, sf_dir, "manual").drop("a_id"))
    return held.withColumn("overridden", F.lit(True)).unionByName(rest.withColumn("overridden", F.lit(False))).select("a_id", "a_name", "overridden")


LAST = ", last AS (SELECT a_name, arg_max(b_name, ordinal) AS mb FROM manual GROUP BY a_name)"
FINAL = LAST + """, final AS (SELECT r.ordinal, r.a_id, r.a_name, CASE WHEN mb IS NULL THEN r.b_name ELSE mb END AS b_name, CASE WHEN mb IS NULL THEN r.b_id END AS b_id,
  CASE WHEN mb IS NULL THEN r.decision ELSE 'MANUAL_MATCH' END AS decision, CASE WHEN mb IS NULL THEN r.score ELSE 1.0 END AS score, CASE WHEN mb IS NULL THEN r.runner_up_score END AS runner_up_score,
  CASE WHEN mb IS NULL THEN '' ELSE 'manual_match' END AS reasons, mb IS NOT NULL AS overridden FROM results r LEFT JOIN last USING (a_name))"""


def _results(spark, sf_dir):
    return relation(spark, sf_dir, "results").withColumn("reasons", F.array().cast("array<string>"))


def _final(spark, sf_dir):
    return overrides.finalize(_results(spark, sf_dir), relation(spark, sf_dir, "manual").drop("a_id"))


@query(WITH + LAST + " SELECT a.a_id, a.a_name, mb AS b_name, CAST(NULL AS VARCHAR) AS b_id, 'MANUAL_MATCH' AS decision, 1.0::DOUBLE AS score, 'manual_match' AS reasons FROM org_a a JOIN last USING (a_name)")
def override_apply(spark, sf_dir):
    rows = overrides.override_rows(org(spark, sf_dir, "a"), relation(spark, sf_dir, "manual").drop("a_id"))
    return rows.select("a_id", "a_name", "b_name", "b_id", "decision", "score", F.array_join("reasons", "|").alias("reasons"))


@query(WITH + FINAL + " SELECT a_id, a_name, b_name, b_id, decision, score, runner_up_score, reasons, overridden FROM final")
def finalize(spark, sf_dir):
    return _final(spark, sf_dir).select("a_id", "a_name", "b_name", "b_id", "decision", "score", "runner_up_score", F.array_join("reasons", "|").alias("reasons"), "overridden")


@query(WITH + FINAL + ", own AS (SELECT a_name, arg_max(struct_pack(b := b_name, i := b_id), ordinal) AS m FROM final WHERE b_name IS NOT NULL GROUP BY a_name) SELECT a_id, a_name, m.b AS b_name, m.i AS b_id FROM org_a LEFT JOIN own USING (a_name)")
def enrich_a(spark, sf_dir):
    return overrides.enrich_a(org(spark, sf_dir, "a"), _final(spark, sf_dir))


B_LIST = ", blist AS (SELECT a_id AS b_key, concat('B', cast(a_id % 90 AS string)) AS b_name FROM org_a)"


def _b_list(spark, sf_dir):
    return org(spark, sf_dir, "a").select(F.col("a_id").alias("b_key"), F.concat(F.lit("B"), (F.col("a_id") % 90).cast("string")).alias("b_name"))


@query(WITH + FINAL + B_LIST + ", own AS (SELECT b_name, string_agg(a_name, '; ' ORDER BY ordinal) AS names FROM final WHERE b_name IS NOT NULL GROUP BY b_name) SELECT b_key, b_name, coalesce(names, '') AS a_names FROM blist LEFT JOIN own USING (b_name)")
def enrich_b(spark, sf_dir):
    return overrides.enrich_b(_b_list(spark, sf_dir), _final(spark, sf_dir)).select("b_key", "b_name", "a_names")


# --- quality -------------------------------------------------------------------------------------


@query("SELECT p_name AS name, min(p_partkey) AS first_id, count(*) AS group_size FROM part WHERE p_name IS NOT NULL GROUP BY p_name")
def group_sizes(spark, sf_dir):
    return quality.grouped(_part_names(spark, sf_dir))


def _part_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("SELECT p_name AS name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1")
def dupes_exact(spark, sf_dir):
    return quality.exact_duplicates(_part_names(spark, sf_dir))


@query("WITH d AS (SELECT count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1) SELECT count(*) AS names, coalesce(sum(n), 0)::BIGINT AS total_rows FROM d")
def dupes_totals(spark, sf_dir):
    return quality.duplicate_totals(_part_names(spark, sf_dir))


@query(WITH + NB + ", d AS (SELECT core_string, name, count(*) AS n FROM nb GROUP BY 1, 2) SELECT core_string, sum(n)::BIGINT AS total, string_agg(name || ' x' || n, '; ' ORDER BY name) AS originals FROM d GROUP BY core_string HAVING sum(n) > 1")
def dupes_normalized(spark, sf_dir):
    rows = quality.normalized_duplicates(org(spark, sf_dir, "b"), name_col="b_name")
    shown = F.array_join(F.transform("originals", lambda o: F.concat(o["name"], F.lit(" x"), o["n"].cast("string"))), "; ")
    return rows.select("core_string", "total", shown.alias("originals"))


CLEAN = {"normalized": STOPWORDS, "no_acronym_collision": [*STOPWORDS, *ACRONYM_COLLISION], "no_branch": [*STOPWORDS, *BRANCH], "no_institution": [*STOPWORDS, *INSTITUTION], "no_location": [*STOPWORDS, *LOCATION], "no_all": [*STOPWORDS, *ACRONYM_COLLISION, *INSTITUTION, *LOCATION]}
CLEAN_SQL = WITH + "".join(norm(f"c_{k}", "org_b", "b_id", "b_name", sorted(set(w))) for k, w in CLEAN.items())
CLEAN_SQL += ", cleaned AS (SELECT c_normalized.name AS original, " + ", ".join(f"c_{k}.core_string AS {k}" for k in CLEAN) + " FROM c_normalized" + "".join(f" JOIN c_{k} USING (id)" for k in CLEAN if k != "normalized") + ")"


@query(CLEAN_SQL + " SELECT * FROM cleaned")
def clean_variants(spark, sf_dir):
    return quality.cleaned(org(spark, sf_dir, "b").select("b_name"), name_col="b_name")


@query(CLEAN_SQL + " SELECT * FROM cleaned WHERE contains(lower(original), 'gmbh') OR " + " OR ".join(f"contains(lower({k}), 'gmbh')" for k in CLEAN))
def clean_filter(spark, sf_dir):
    return quality.filtered(quality.cleaned(org(spark, sf_dir, "b").select("b_name"), name_col="b_name"), "GmbH")


# --- summaries, evaluation -----------------------------------------------------------------------


@query(WITH + " SELECT decision, count(*) AS n FROM results GROUP BY decision")
def decision_summary(spark, sf_dir):
    return evaluate.decision_summary(relation(spark, sf_dir, "results"))


@query(WITH + " SELECT decision, sum(group_size)::BIGINT AS n FROM results GROUP BY decision")
def decision_summary_weighted(spark, sf_dir):
    return evaluate.decision_summary(relation(spark, sf_dir, "results"), "group_size")


RATIOS = "SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM m"


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("total", "tp", "fp", "fn", "tn", "ambiguous", "llm_calls", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


RATIOS_SQL = ", r AS (" + RATIOS + ") SELECT total, tp, fp, fn, tn, ambiguous, llm_calls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1 FROM r"


@query(WITH + """, m AS (SELECT count(*) AS total, count(*) FILTER (decision = 'MATCH' AND label = 1) AS tp, count(*) FILTER (decision = 'MATCH' AND label <> 1) AS fp, count(*) FILTER (decision <> 'MATCH' AND label = 1) AS fn,
 count(*) FILTER (decision <> 'MATCH' AND label <> 1) AS tn, count(*) FILTER (decision = 'REVIEW') AS ambiguous, count(*) FILTER (used_llm) AS llm_calls FROM results)""" + RATIOS_SQL)
def eval_pairs(spark, sf_dir):
    return _rounded(evaluate.evaluate_pairs(relation(spark, sf_dir, "results")))


@query(WITH + """, j AS (SELECT r.decision, r.used_llm, t.b_id AS true_b, r.decision = 'MATCH' AS said, coalesce(r.decision = 'MATCH' AND r.a_id + (CASE WHEN r.a_id % 7 = 0 THEN 1 ELSE 0 END) = t.b_id, false) AS good FROM results r LEFT JOIN truth t USING (a_id)),
m AS (SELECT count(*) AS total, count(*) FILTER (good) AS tp, count(*) FILTER (said AND NOT good) AS fp, count(*) FILTER (NOT said AND true_b IS NOT NULL) AS fn, count(*) FILTER (NOT said AND true_b IS NULL) AS tn,
 count(*) FILTER (decision = 'REVIEW') AS ambiguous, count(*) FILTER (used_llm) AS llm_calls FROM j)""" + RATIOS_SQL)
def eval_lists(spark, sf_dir):
    """Stand-in predictions: the right b but for every seventh id."""
    rows = relation(spark, sf_dir, "results").withColumn("b_id", F.col("a_id") + F.when(F.col("a_id") % 7 == 0, 1).otherwise(0))
    return _rounded(evaluate.evaluate_lists(rows, relation(spark, sf_dir, "truth")))


@query()
def eval_linked(spark, sf_dir):
    """The whole linker against the labels."""
    return _rounded(linker.evaluate_lists(org(spark, sf_dir, "a"), org(spark, sf_dir, "b"), relation(spark, sf_dir, "truth")))


@query(WITH + ", w AS (SELECT unnest(CASE WHEN score >= 0.5 THEN ['fuzzy_high', 'core_overlap_high'] ELSE ['core_overlap_high'] END) AS reason FROM results WHERE decision = 'MATCH' AND label <> 1) SELECT reason, count(*) AS n FROM w GROUP BY reason")
def fp_reasons(spark, sf_dir):
    two, one = (F.array(*map(F.lit, x)) for x in (("fuzzy_high", "core_overlap_high"), ("core_overlap_high",)))
    return evaluate.false_positive_reasons(relation(spark, sf_dir, "results").withColumn("reasons", F.when(F.col("score") >= 0.5, two).otherwise(one)))


@query(BOTH + CAPPED + ", n AS (SELECT org_a.a_id, count(capped.b_id) AS c FROM org_a LEFT JOIN capped USING (a_id) GROUP BY org_a.a_id) SELECT count(*) AS a_count, sum(c)::BIGINT AS comparisons, count(*) FILTER (c = 0) AS no_candidates, 0::BIGINT AS llm_used, (SELECT count(*) FROM org_b) AS b_count FROM n")
def matcher_stats(spark, sf_dir):
    b = org(spark, sf_dir, "b")
    counts = blocking.candidate_counts(capped_pairs(spark, sf_dir))
    rows = org(spark, sf_dir, "a").join(counts, "a_id", "left").select(F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.lit(False).alias("used_llm"))
    return evaluate.matcher_stats(rows, b)


@query(WITH + """ SELECT count(*) FILTER (decision = 'MATCH') AS n_match, count(*) FILTER (decision = 'NO_MATCH') AS n_no_match, count(*) FILTER (decision = 'REVIEW') AS n_review,
 count(*) FILTER (used_llm AND decision IN ('MATCH', 'NO_MATCH')) AS llm_overrides, 3::BIGINT AS embedding_api_calls, 5::BIGINT AS embedding_cache_hits FROM results""")
def run_stats(spark, sf_dir):
    """Counters of embedding are stand-ins here; a test holds them against a provider's calls."""
    return evaluate.run_stats(relation(spark, sf_dir, "results"), {"api_calls": 3, "cache_hits": 5})


@query(WITH + LAST + ", every AS (SELECT a.a_id, a.a_name, CASE WHEN mb IS NULL THEN 'NO_MATCH' ELSE 'MANUAL_MATCH' END AS decision FROM org_a a LEFT JOIN last USING (a_name)) SELECT *, row_number() OVER (ORDER BY decision <> 'MANUAL_MATCH', a_id) AS place FROM every")
def output_order(spark, sf_dir):
    """Manual matches first, then the order of the input: places in the order that sinks write in."""
    from pyspark.sql import Window

    from namewright.sources.names import in_order

    a, manual = org(spark, sf_dir, "a"), relation(spark, sf_dir, "manual").drop("a_id")
    _, rest = overrides.split_overrides(a, manual)
    rows = rest.withColumn("decision", F.lit("NO_MATCH")).unionByName(overrides.override_rows(a, manual).select("a_id", "a_name", "decision"))
    place = F.row_number().over(Window.orderBy(F.col("decision") != "MANUAL_MATCH", "a_id")).cast("long")
    return in_order(rows).withColumn("place", place).select("a_id", "a_name", "decision", "place")


# --- review --------------------------------------------------------------------------------------

GROUPS = """, f AS (SELECT b_name, a_name, min(ordinal) AS ordinal, arg_min(struct_pack(i := b_id, s := score), ordinal) AS own FROM results WHERE decision = '{0}' AND b_name IS NOT NULL GROUP BY 1, 2)
SELECT b_name, arg_min(own, ordinal).i AS b_id, arg_min(own, ordinal).s AS score, string_agg(a_name, '; ' ORDER BY ordinal) AS a_names FROM f GROUP BY b_name"""


def _groups(spark, sf_dir, decision):
    return review.groups_by_b(relation(spark, sf_dir, "results"), decision).withColumn("a_names", F.array_join("a_names", "; "))


@query(WITH + GROUPS.format("MATCH"))
def review_auto_groups(spark, sf_dir):
    return _groups(spark, sf_dir, "MATCH")


@query(WITH + GROUPS.format("REVIEW"))
def review_suggested_groups(spark, sf_dir):
    return _groups(spark, sf_dir, "REVIEW")


@query(WITH + " SELECT DISTINCT a_name FROM results WHERE decision = 'REVIEW' AND b_name IS NULL")
def review_a_names(spark, sf_dir):
    return review.review_names(relation(spark, sf_dir, "results"))


CUSTOM = ", cm AS (SELECT concat('B', cast(a_id % 90 AS string)) AS b_name FROM manual)"
TYPED = B_LIST + CUSTOM + """, typed AS (SELECT b_key, b_name, CASE WHEN b_name IN (SELECT b_name FROM cm) THEN 'CM' WHEN b_name IN (SELECT b_name FROM results WHERE decision = 'MATCH' AND b_name IS NOT NULL) THEN 'AM'
 WHEN b_name IN (SELECT b_name FROM results WHERE decision = 'REVIEW' AND b_name IS NOT NULL) THEN 'RV' END AS match_type FROM blist)"""


def _typed(spark, sf_dir):
    manual = relation(spark, sf_dir, "manual").select(F.concat(F.lit("B"), (F.col("a_id") % 90).cast("string")).alias("b_name"))
    return review.match_types(_b_list(spark, sf_dir), manual, relation(spark, sf_dir, "results"))


@query(WITH + TYPED + " SELECT * FROM typed")
def b_match_type(spark, sf_dir):
    return _typed(spark, sf_dir)


@query(WITH + TYPED + " SELECT * FROM typed WHERE match_type IS NULL")
def b_not_matched(spark, sf_dir):
    return review.with_type(_typed(spark, sf_dir), "NM")


@query(WITH + " SELECT a_id, a_name FROM org_a WHERE contains(lower(a_name), 'brand#1')")
def search_a(spark, sf_dir):
    return review.search(org(spark, sf_dir, "a"), "BRAND#1", "a_name")


@query(WITH + " SELECT a_id, a_name, a_name IN (SELECT a_name FROM manual) AS relevant, row_number() OVER (ORDER BY (a_name IN (SELECT a_name FROM manual)) DESC, a_id) AS place FROM org_a")
def list_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = review.listed_first(org(spark, sf_dir, "a"), relation(spark, sf_dir, "manual"), "a_name", "a_id")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("relevant"), "a_id")).cast("long")).select("a_id", "a_name", "relevant", "place")


@query(WITH + " SELECT a_name, group_size, b_name, b_id, score FROM results WHERE decision = 'MATCH'")
def display_matches(spark, sf_dir):
    return review.display(relation(spark, sf_dir, "results"))


# --- vectors and arbitration ---------------------------------------------------------------------


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), "embedding")


VECTORS = "WITH v AS (SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT * FROM v WHERE id % 20 = 0)"


@query(VECTORS + " SELECT q.id AS a_id, v.id AS b_id, round(list_cosine_similarity(q.e, v.e), 4) AS similarity FROM v AS q JOIN v ON v.id BETWEEN q.id AND q.id + 9")
def vec_cosine_pairs(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    pairs = v.select(F.col("id").alias("a_id"), F.col("embedding").alias("x"), F.explode(F.sequence(F.col("id"), F.col("id") + 9)).alias("b_id"))
    pairs = pairs.join(v.select(F.col("id").alias("b_id"), F.col("embedding").alias("y")), "b_id")
    return pairs.select("a_id", "b_id", F.round(cosine(F.col("x"), F.col("y")), 4).alias("similarity"))


@query(VECTORS + ", s AS (SELECT q.id AS a_id, v.id AS b_id, list_cosine_similarity(q.e, v.e) AS c FROM q, v) SELECT a_id, b_id, round(c, 4) AS similarity, row_number() OVER (PARTITION BY a_id ORDER BY c DESC, b_id) AS rank FROM s QUALIFY rank <= 10")
def vec_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    rows = vectors.nearest(v.where("id % 20 = 0"), v, 10)
    return rows.select("a_id", "b_id", F.round("similarity", 4).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query()
def embedding_cache(spark, sf_dir):
    """Missing texts of b once each, beside a cache that holds a third of them."""
    texts = normalized(spark, sf_dir, "b").select(F.col("core_string").alias("text"))
    embedder = vectors.HashEmbedder()
    cache = vectors.embed_missing(texts.where(F.crc32(F.col("text").cast("binary")) % 3 == 0), None, embedder)
    return vectors.embed_missing(texts, cache, embedder).select("text", F.size("embedding").alias("dims"))


@query(BOTH + JOINED + """ SELECT a_id, b_id, NOT (len(an) > 0 AND len(bn) > 0 AND an <> bn) AND NOT (len(ac) < 2 AND len(bc) < 2) AND ((a_id + b_id) % 100)::DOUBLE / 100 - 0.1 < 0.75 AND NOT (len(ac) = 1 AND len(bc) = 1) AS ok FROM rel""")
def llm_eligible(spark, sf_dir):
    rows = sided_pairs(spark, sf_dir)
    s = ((F.col("a_id") + F.col("b_id")) % 100).cast("double") / 100
    test = arbiter.eligible(Arbitration(enabled=True), F.col("a_core_tokens"), F.col("b_core_tokens"), F.col("a_numeric_tokens"), F.col("b_numeric_tokens"), s, F.lit(0.1))
    return rows.select("a_id", "b_id", test.alias("ok"))


REPLIES = """WITH replies AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"decision": "SAME", "confidence": 0.' || event_id % 10 || ', "reason": "r' || event_id % 3 || '"}' WHEN 1 THEN '{"decision": "DIFFERENT"}' WHEN 2 THEN 'no json' WHEN 3 THEN '{"confidence": "0.9"}' ELSE props END AS raw FROM events)"""


@query(REPLIES + """ SELECT event_id, CASE WHEN json_valid(raw) THEN coalesce(json_extract_string(raw, '$.decision'), 'UNSURE') ELSE 'UNSURE' END AS decision, CASE WHEN json_valid(raw) THEN coalesce(json_extract_string(raw, '$.confidence')::DOUBLE, 0.0) ELSE 0.0 END AS confidence,
 CASE WHEN json_valid(raw) THEN coalesce(json_extract_string(raw, '$.reason'), '') ELSE 'parse_error' END AS reason FROM replies""")
def llm_parse(spark, sf_dir):
    e = F.col("event_id")
    raw = (
        F.when(e % 5 == 0, F.concat(F.lit('{"decision": "SAME", "confidence": 0.'), (e % 10).cast("string"), F.lit(', "reason": "r'), (e % 3).cast("string"), F.lit('"}')))
        .when(e % 5 == 1, F.lit('{"decision": "DIFFERENT"}')).when(e % 5 == 2, F.lit("no json")).when(e % 5 == 3, F.lit('{"confidence": "0.9"}')).otherwise(F.col("props"))
    )
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", arbiter.parse_reply(raw).alias("r"))
    return rows.select("event_id", "r.decision", "r.confidence", "r.reason")


@query(WITH + NA + NB + " SELECT na.id AS a_id, nb.id AS b_id, substr(sha256(na.core_string), 1, 16) || '::' || substr(sha256(nb.core_string), 1, 16) AS cache_key FROM na JOIN nb ON na.id = nb.id")
def llm_cache_key(spark, sf_dir):
    a, b = (normalized(spark, sf_dir, s).select(F.col(f"{s}_id").alias("id"), F.col("core_string").alias(s)) for s in "ab")
    return a.join(b, "id").select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), T.pair_key(F.col("a"), F.col("b")).alias("cache_key"))


# --- exports -------------------------------------------------------------------------------------


@query(WITH + """ SELECT a_id::VARCHAR AS a_id, a_name, coalesce(b_id, '') AS b_id, coalesce(b_name, '') AS b_name, decision, printf('%.4f', score) AS score, CASE WHEN runner_up_score IS NULL THEN '' ELSE printf('%.4f', runner_up_score) END AS runner_up_score,
 CASE WHEN runner_up_score IS NULL THEN '' ELSE printf('%.4f', score - runner_up_score) END AS margin, used_llm::VARCHAR AS used_llm, 'core_overlap_high|fuzzy_high' AS reasons FROM results""")
def export_csv_rows(spark, sf_dir):
    rows = relation(spark, sf_dir, "results").withColumn("margin", F.col("score") - F.col("runner_up_score"))
    return csv_rows(rows.withColumn("reasons", F.array(F.lit("core_overlap_high"), F.lit("fuzzy_high"))))


@query(WITH + " SELECT a_name, group_size, b_name, b_id, decision, round(score, 4) AS score, round(runner_up_score, 4) AS runner_up_score, 'a; b' AS reasons FROM results")
def export_review_rows(spark, sf_dir):
    return export_rows(relation(spark, sf_dir, "results").withColumn("reasons", F.array(F.lit("a"), F.lit("b"))))

"""Linking a list of names to a reference list, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.functions.text import pair_key
from namewright.operators import arbiter as arb
from namewright.operators import blocking, decide, evaluate, overrides, scoring, vectors
from namewright.operators.normalize import normalize, normalize_once
from namewright.plans.config import Config
from namewright.plans.lexicon import Lexicon


@dataclass
class Linker:
    """config, lexicon and optional providers; prepare() takes the reference list, link() a list."""

    config: Config = Config()
    lexicon: Lexicon = Lexicon()
    embedder: vectors.Embedder | None = None
    judge: arb.Judge | None = None

    def prepare(self, b: DataFrame) -> Prepared:
        """b (b_id, b_name, maybe b_ext_id), normalized once."""
        return Prepared(self, b, normalize_once(b, self.config, self.lexicon, "b_name"), vectors.EmbeddingCache(self.config.embedding.cache_dir))


@dataclass
class Prepared:
    linker: Linker
    b: DataFrame
    normalized: DataFrame
    cache: vectors.EmbeddingCache

    def candidates(self, a_normalized: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
        c = self.linker.config
        near = None
        if embeddings is not None:
            near = vectors.nearest(self._vectors(a_normalized, "a_id", embeddings), self._vectors(self.normalized, "b_id", embeddings), c.embedding.neighbors)
        return blocking.merge_candidates(blocking.best_candidates(a_normalized, self.normalized, c.candidates.max_lexical), near, c.candidates)

    def embeddings(self, a_normalized: DataFrame) -> DataFrame | None:
        """(text, embedding) of the cores of both sides, each sent to the provider at most once; None if
        embeddings are off."""
        c = self.linker.config.embedding
        if not c.enabled or self.linker.embedder is None:
            return None
        texts = a_normalized.select(F.col("core_string").alias("text")).unionByName(self.normalized.select(F.col("core_string").alias("text")))
        return self.cache.embed(texts, self.linker.embedder, c.batch_size)

    def _vectors(self, rows: DataFrame, id_col: str, embeddings: DataFrame) -> DataFrame:
        return rows.select(F.col(id_col).alias("id"), F.col("core_string").alias("text")).join(embeddings, "text").select("id", "embedding")

    def scored(self, a: DataFrame) -> DataFrame:
        """a (a_id, a_name) -> scored candidates.  The fuzzy ratio is made once for each two cores."""
        return self._scored(normalize(a, self.linker.config, self.linker.lexicon, "a_name"))

    def _scored(self, left: DataFrame) -> DataFrame:
        config, lexicon = self.linker.config, self.linker.lexicon
        embeddings = self.embeddings(left)
        pairs = self.candidates(left, embeddings)
        sides = [(left, "a"), (self.normalized, "b")]
        # By the size of its files, Spark takes a normalized list for small and would broadcast it through the
        # driver; here and in what follows joins with lists are always shuffled.
        for rows, s in sides:
            pairs = pairs.join(scoring.side(rows, f"{s}_id", f"{s}_", lexicon).hint("merge"), f"{s}_id")
        if embeddings is not None:
            from namewright.functions.similarity import cosine

            for rows, s in sides:
                pairs = pairs.join(self._vectors(rows, f"{s}_id", embeddings).withColumnsRenamed({"id": f"{s}_id", "embedding": f"{s}_vec"}), f"{s}_id")
            pairs = pairs.withColumn("cosine", cosine(F.col("a_vec"), F.col("b_vec"))).drop("a_vec", "b_vec")
        return scoring.score(scoring.features(pairs, config, lexicon), config)

    def link(self, a: DataFrame, manual: DataFrame | None = None) -> DataFrame:
        """One row for each a.  Equal names are linked once; overridden names are not linked at all."""
        rest = a.where(F.col("a_name").isNotNull())
        if manual is not None:
            _, rest = overrides.split_overrides(rest, manual)
        once = rest.groupBy("a_name").agg(F.min("a_id").alias("a_id"))
        left = normalize(once, self.linker.config, self.linker.lexicon, "a_name")
        scored = self._scored(left)
        found = decide.decide(scored, left.select("a_id", "a_name", "warnings"), self.b, self.linker.config.thresholds)
        if self.linker.config.arbitration.enabled:
            found = self._arbitrated(found, scored, once)
        out = rest.hint("merge").join(found.drop("a_id"), "a_name").select(found.columns)
        return out if manual is None else out.unionByName(overrides.override_rows(a, manual), allowMissingColumns=True)

    def _arbitrated(self, found: DataFrame, scored: DataFrame, once: DataFrame) -> DataFrame:
        """Judge the top candidates of names under review, in order, until the budget is spent."""
        config = self.linker.config.arbitration
        rows = decide.ranked(scored).where(F.col("rank") <= max(config.top_k, 2))
        second = rows.where("rank = 2").select("a_id", F.col("score").alias("second"))
        rows = rows.where(F.col("rank") <= config.top_k).drop("runner_up_score").join(second, "a_id", "left").join(found.where("decision = 'REVIEW'").select("a_id", "a_name"), "a_id")
        test = arb.eligible(config, F.col("a_core_tokens"), F.col("b_core_tokens"), F.col("a_numeric_tokens"), F.col("b_numeric_tokens"), F.col("score"), F.col("second"))
        rows = rows.where(test).join(self.b.select("b_id", "b_name"), "b_id").withColumn("key", pair_key(F.col("a_core_string"), F.col("b_core_string")))
        shown = rows.select("a_id", "b_id", "a_name", "b_name", "key", "score", "reasons", "rank").orderBy("a_id", "rank")
        ignored = self.linker.config.strip_categories
        judge = arb.Arbiter(config, self.linker.judge)
        # Rows come one partition at a time and no further than the budget of calls reaches.
        told = judge.settle(r.asDict() | {"prompt": arb.prompt(r.a_name, r.b_name, {"score": round(r.score, 4), "reasons": r.reasons}, ignored)} for r in shown.toLocalIterator())
        spark = found.sparkSession
        made = spark.createDataFrame([(a, *v) for a, v in told.items()], "a_id long, j_decision string, j_b long, j_score double, j_reasons array<string>")
        laid = found.join(F.broadcast(made), "a_id", "left").join(self.b.select(F.col("b_id").alias("j_b"), F.col("b_name").alias("j_name")), "j_b", "left")
        hit, match = F.col("j_decision").isNotNull(), F.col("j_decision") == "MATCH"
        special = {
            "decision": F.coalesce("j_decision", "decision"), "score": F.coalesce("j_score", "score"), "reasons": F.coalesce("j_reasons", "reasons"), "used_llm": hit,
            "b_id": F.when(hit, F.when(match, F.col("j_b"))).otherwise(F.col("b_id")), "b_name": F.when(hit, F.when(match, F.col("j_name"))).otherwise(F.col("b_name")),
        }
        return laid.select(*[special[c].alias(c) if c in special else F.col(c) for c in found.columns])


def link_one(prepared: Prepared, name: str, a_id: int = 0):
    """One name through the same plan."""
    spark = prepared.b.sparkSession
    return prepared.link(spark.createDataFrame([(a_id, name)], "a_id long, a_name string")).first()


def evaluate_pairs(pairs: DataFrame, linker: Linker = Linker()) -> DataFrame:
    """pairs (name_a, name_b, label): each decided against its own b alone; only pairs that share a
    key are candidates, and there is no runner-up."""
    rows = pairs.withColumn("a_id", F.xxhash64("name_a", "name_b"))
    once = rows.dropDuplicates(["a_id"])
    sides = {s: normalize(once.select("a_id", F.col(f"name_{s}").alias("name")), linker.config, linker.lexicon) for s in "ab"}
    joined = once.select("a_id")
    for s, n in sides.items():
        joined = joined.join(n.select("a_id", F.col("keys").alias(f"{s}_keys")), "a_id").join(scoring.side(n, "a_id", f"{s}_", linker.lexicon), "a_id")
    joined = joined.where(F.arrays_overlap("a_keys", "b_keys"))
    scored = scoring.score(scoring.features(joined, linker.config, linker.lexicon), linker.config)
    decision = decide.band(F.col("score"), F.lit(None).cast("double"), linker.config.thresholds)
    told = rows.join(scored.select("a_id", "score", "reasons", decision.alias("decision")), "a_id", "left")
    return told.select("name_a", "name_b", "label", F.coalesce("decision", F.lit("NO_MATCH")).alias("decision"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("reasons", F.array(F.lit("no_candidates"))).alias("reasons"), F.lit(False).alias("used_llm"))


def evaluate_lists(a: DataFrame, b: DataFrame, truth: DataFrame, linker: Linker = Linker()) -> DataFrame:
    return evaluate.evaluate_lists(linker.prepare(b).link(a), truth)

"""Names, scores, decisions and the rest of the linking engine on literal cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from namewright.functions import similarity as S
from namewright.operators import arbiter, vectors
from namewright.operators.normalize import normalize
from namewright.operators.overrides import ManualStore
from namewright.plans import linker, queries
from namewright.plans.config import Arbitration, Config
from namewright.sources import names as io

CORES = {
    "Apple Inc.": "apple", "Ｆｕｌｌｗｉｄｔｈ Corp": "fullwidth", "Johnson & Johnson": "johnson johnson", "Procter & Gamble, Inc.": "procter gamble", "General Electric Corp.": "general electric",
    "LLC Corp": "llc corp", "3M Company": "3m", "The Goldman Sachs Group Inc": "goldman sachs group", "7-Eleven Inc": "7eleven", "???": "", "Foo Bar Ltd Corp": "foo bar", "intl, tools": "intl tools", "intl tools": "international tools",
}


def test_normalize(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(CORES)] + [(99, None)], "id int, name string")
    assert {r.name: r.core_string for r in normalize(rows).collect()} == CORES
    got = {r.name: r for r in normalize(spark.createDataFrame([("I.B.M.",), ("International Business Machines",), ("ACME",), ("Acme",), ("USA Trade Co",)], "name string")).collect()}
    assert [got[n].acronym for n in ("I.B.M.", "International Business Machines", "ACME", "Acme")] == ["ibm", "ibm", "acme", None]


def test_fuzzy_ratios():
    assert abs(S.ratio("this is a test", "this is a test!") - 96.5517) < 1e-3
    assert S.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert S.weighted_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 95
    assert S.weighted_ratio("", "a") == 0 and S.weighted_ratio("apple", "apple") == 100


DECISIONS = [
    ("Apple Inc.", ["Apple Inc", "Microsoft Corp", "Google LLC"], "MATCH", 1.0), ("Apple Inc", ["Apple Corp", "Apple LLC"], "REVIEW", 1.0), ("Zzzzz Unique Name", ["Alpha Corp", "Beta Ltd"], "NO_MATCH", 0.0),
    ("Acme", ["Acme Solutions", "Acme Services", "Google LLC"], "REVIEW", 0.9538), ("General Electric Company", ["General Electric Power"], "MATCH", 0.9769), ("Johnson and Johnson", ["Johnson & Johnson", "Johnson Controls International"], "MATCH", 1.0),
]


@pytest.mark.parametrize(("a", "b", "decision", "score"), DECISIONS)
def test_decisions(spark, a, b, decision, score):
    prepared = linker.Linker().prepare(spark.createDataFrame(list(enumerate(b)), "b_id long, b_name string"))
    got = linker.link_one(prepared, a)
    assert (got.decision, round(got.score, 4)) == (decision, score)
    assert (got.b_name == b[0]) == (decision == "MATCH")


def test_arbitration(spark):
    class Judge:
        def query(self, prompt):
            return '{"decision": "SAME", "confidence": 0.9, "reason": "x"}' if "Acme Services" in prompt else "no json"

    config = Config(arbitration=Arbitration(enabled=True))
    b = spark.createDataFrame([(1, "Acme Solutions"), (2, "Acme Services")], "b_id long, b_name string")
    got = linker.link_one(linker.Linker(config, judge=Judge()).prepare(b), "Acme")
    assert (got.decision, got.b_id, got.used_llm) == ("MATCH", 2, True)
    judge = arbiter.Arbiter(Arbitration(enabled=True, global_call_cap=0), Judge())
    assert judge.settle([{"a_id": 1, "b_id": 1, "key": "k", "prompt": "Acme Services", "score": 1.0, "reasons": []}]) == {}


def test_embeddings_and_neighbors(spark):
    config = Config(embedding=linker.Config().embedding.__class__(enabled=True, neighbors=2))
    b = spark.createDataFrame([(1, "Acme Solutions"), (2, "Other Thing")], "b_id long, b_name string")
    got = linker.link_one(linker.Linker(config, embedder=vectors.HashEmbedder()).prepare(b), "Something Else")
    assert got.candidate_count == 2


def test_files_and_store(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name\nApple Inc\n\n  Beta \n")
    (tmp_path / "a.jsonl").write_text('{"id": 7, "name": " Gamma "}\n\n{"id": 8, "name": null}\n')
    assert [r.name for r in io.read_names(spark, str(tmp_path / "a.csv")).collect()] == ["Apple Inc", "Beta"]
    assert [tuple(r) for r in io.read_names(spark, str(tmp_path / "a.jsonl")).collect()] == [(7, "Gamma")]
    store = ManualStore.open(tmp_path / "m" / "matches.json")
    store.add(["x", "y"], "B", "1")
    assert ManualStore.open(store.path).by_name() == {"x": ("B", "1"), "y": ("B", "1")}
    assert [r.a_name for r in io.read_manual(spark, str(store.path)).orderBy("ordinal").collect()] == ["x", "y"]
    assert io.read_manual(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(ValueError):
        store.add([], "B")
    with pytest.raises(IndexError):
        store.remove(5)


@pytest.mark.parametrize("name", ["norm_core_a", "acronyms", "candidates_capped", "score_given_fuzzy", "finalize", "enrich_b", "dupes_normalized", "clean_variants", "eval_lists", "b_match_type", "vec_topk", "export_csv_rows"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("part", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    plain = lambda rows: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(map(tuple, got.select(*[F.col(c) for c in columns]).collect())) == plain(want.fetchall())

"""Readers, sinks, the command line, streams, word lists and the embedding cache."""

import csv
import json
from pathlib import Path

import pytest

from namewright import cli
from namewright.operators import evaluate, vectors
from namewright.plans import linker
from namewright.plans.config import Config, Embedding
from namewright.plans.lexicon import load_lexicon
from namewright.sources import names as io
from namewright.streaming.linking import link_stream


def read_back(folder, kind):
    """Rows of a sink's files in order."""
    out = []
    for f in sorted(Path(folder).glob(f"part-*.{kind}")):
        text = f.read_text()
        out += [json.loads(x) for x in text.splitlines()] if kind == "json" else list(csv.DictReader(text.splitlines()))
    return out


def test_names_of_files(spark, tmp_path):
    (tmp_path / "tabs.csv").write_text('id,name\n1,"\tApple "\n2,"\t"\n3," B, C "\n')
    assert [tuple(r) for r in io.read_names(spark, str(tmp_path / "tabs.csv")).orderBy("id").collect()] == [(1, "Apple"), (3, "B, C")]
    (tmp_path / "other.csv").write_text("company_id,company_name\n10,Google LLC\n")
    assert [tuple(r) for r in io.read_names(spark, str(tmp_path / "other.csv"), "company_name", "company_id").collect()] == [(10, "Google LLC")]
    (tmp_path / "places.jsonl").write_text('{"name": "A"}\n\n{"name": "\\tB "}\n{"name": " "}\n{"id": 40, "name": "C"}\n{"name": "D"}\n')
    assert sorted(tuple(r) for r in io.read_names(spark, str(tmp_path / "places.jsonl")).collect()) == [(0, "A"), (2, "B"), (5, "D"), (40, "C")]
    (tmp_path / "pairs.csv").write_text('name_a,name_b,label\n"\tApple Inc",Apple Incorporated ,1\nA,B,0\n')
    pairs = io.read_labeled_pairs(spark, str(tmp_path / "pairs.csv"))
    assert [tuple(r) for r in pairs.collect()] == [("Apple Inc", "Apple Incorporated", 1), ("A", "B", 0)]
    got = evaluate.evaluate_pairs(linker.evaluate_pairs(pairs)).first()
    assert (got.total, got.tp, got.tn, got.fp, got.fn) == (2, 1, 1, 0, 0)


def test_sinks_keep_order_and_columns(spark, tmp_path):
    b = spark.createDataFrame([(0, "Apple Incorporated"), (1, "Beta Ltd")], "b_id long, b_name string")
    a = spark.createDataFrame([(0, "Zeta"), (1, "Apple Inc"), (2, "Manual Name"), (3, "Apple Inc")], "a_id long, a_name string")
    manual = spark.createDataFrame([(0, "Manual Name", "Beta Ltd", "1", "")], "ordinal long, a_name string, b_name string, b_id string, notes string")
    found = linker.Linker().prepare(b.withColumn("b_id", b.b_id.cast("string"))).link(a, manual)
    for kind, path in (("csv", tmp_path / "out.csv"), ("json", tmp_path / "out.jsonl")):
        for debug in (False, True):
            io.write_results(found, f"{path}-{debug}.{'jsonl' if kind == 'json' else 'csv'}", debug)
            rows = read_back(f"{path}-{debug}.{'jsonl' if kind == 'json' else 'csv'}", kind)
            assert [str(r["a_id"]) for r in rows] == ["2", "0", "1", "3"]
            assert [r["decision"] for r in rows] == ["MANUAL_MATCH", "NO_MATCH", "MATCH", "MATCH"]
            assert ("warnings" in rows[0]) == debug and ("top_candidates" in rows[0]) == debug
    text = read_back(f"{tmp_path / 'out.csv'}-True.csv", "csv")
    assert text[2]["score"] == "1.0000" and text[1]["b_id"] == "" and text[1]["reasons"] == "no_candidates"
    assert text[1]["warnings"] == "single_token_core" and json.loads(text[2]["top_candidates"])[0]["b_id"] == "0"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "a.csv").write_text("name\nApple Inc\nZeta\nApple Inc\nGamma GmbH\n")
    (tmp_path / "b.csv").write_text("id,name\n7,Apple Incorporated\n8,Delta\n8,Delta\n")
    (tmp_path / "m.json").write_text(json.dumps({"matches": [{"a_names": ["Zeta"], "b_name": "Delta", "b_id": None, "created_at": "", "notes": ""}]}))
    p = lambda n: str(tmp_path / n)
    out = {r.a_name: r for r in cli.main(["match", p("a.csv"), p("b.csv"), p("out.parquet"), "--group", "--show", "--matches", p("m.json")]).collect()}
    assert (out["Apple Inc"].decision, out["Apple Inc"].group_size, out["Zeta"].decision) == ("MATCH", 2, "MANUAL_MATCH")
    assert "MANUAL_MATCH" in capsys.readouterr().out
    assert [tuple(r) for r in cli.main(["dupes", p("b.csv"), "--exact"]).collect()] == [("Delta", 2)]
    assert [r.total for r in cli.main(["dupes", p("a.csv")]).collect()] == [2]
    assert [r.normalized for r in cli.main(["clean", p("a.csv"), p("clean"), "--filter", "GMBH"]).collect()] == ["gamma"]
    done = {r.a_name: r for r in cli.main(["finalize", p("out.parquet"), p("m.json"), p("final"), "--a", p("a.csv"), "--b", p("b.csv")]).collect()}
    assert (done["Zeta"].b_name, done["Zeta"].overridden, done["Apple Inc"].overridden) == ("Delta", True, False)
    assert sorted((r.a_id, r.b_name) for r in spark.read.parquet(p("final_a")).collect()) == [(0, "Apple Incorporated"), (1, "Delta"), (2, "Apple Incorporated"), (3, None)]
    assert sorted((r.b_id, r.a_names) for r in spark.read.parquet(p("final_b")).collect()) == [(7, "Apple Inc"), (8, "Zeta"), (8, "Zeta")]


def test_streams_link_each_batch(spark, tmp_path):
    prepared = linker.Linker().prepare(spark.createDataFrame([(1, "Apple Incorporated")], "b_id long, b_name string"))
    (tmp_path / "in").mkdir()
    for i, n in enumerate(("Apple Inc", "Other")):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"a_id": i, "a_name": n}) + "\n")
    names = spark.readStream.schema("a_id long, a_name string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = {}
    q = link_stream(names, prepared, lambda rows, n: seen.update({(n, r.a_id): r.decision for r in rows.collect()}), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert sorted(seen.values()) == ["MATCH", "NO_MATCH"] and len({n for n, _ in seen}) == 2


def test_lexicon_of_a_folder(tmp_path, monkeypatch):
    for name, text in {"designators_global.txt": "inc\n\nLTD\n", "acronym_collision.txt": "abc\n", "branch.txt": "north\n", "designator_aliases.json": "{broken", "replacements.json": '{"&": " and "}'}.items():
        (tmp_path / name).write_text(text)
    monkeypatch.setenv("NAMEWRIGHT_LEXICON", str(tmp_path))
    own = load_lexicon()
    assert own.designators == ("inc", "ltd") and own.aliases == {} and own.replacements == {"&": " and "}
    assert own.category_names() == ["acronym_collision", "branch"] and own.words("branch", "nothing") == ["north"]
    (tmp_path / "replacements.json").write_text("{broken")
    with pytest.raises(json.JSONDecodeError):
        load_lexicon(str(tmp_path))


class Counting(vectors.HashEmbedder):
    """Writes down each call, wherever it runs."""

    def __init__(self, path):
        super().__init__(4)
        self.path = str(path)

    def embed_batch(self, texts):
        with open(self.path, "a") as f:
            f.write(json.dumps(texts) + "\n")
        return super().embed_batch(texts)


@pytest.mark.parametrize("kept", [True, False])
def test_each_text_is_embedded_once(spark, tmp_path, kept):
    provider = Counting(tmp_path / "calls")
    config = Config(embedding=Embedding(enabled=True, neighbors=2, batch_size=2, cache_dir=str(tmp_path / "cache") if kept else ""))
    b = spark.createDataFrame([(1, "Acme Solutions"), (2, "Other Thing"), (3, "Acme Solutions Inc")], "b_id long, b_name string")
    a = spark.createDataFrame([(1, "Something Else"), (2, "Other Thing")], "a_id long, a_name string")
    prepared = linker.Linker(config, embedder=provider).prepare(b)
    assert len(prepared.link(a).collect()) == 2
    calls = [json.loads(x) for x in (tmp_path / "calls").read_text().splitlines()]
    assert sorted(t for c in calls for t in c) == ["acme solutions", "other thing", "something else"]
    assert prepared.cache.counts["api_calls"] == len(calls) and all(len(c) <= 2 for c in calls)
    again = prepared if not kept else linker.Linker(config, embedder=provider).prepare(b)
    again.link(a).collect()
    assert len((tmp_path / "calls").read_text().splitlines()) == len(calls) and again.cache.counts["cache_hits"] == 3


def test_json_cache(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"apple": [1.0, 0.0], "b": [0.5, 0.5]}')
    assert sorted((r.text, list(r.embedding)) for r in vectors.read_json_cache(spark, str(tmp_path / "c.json")).collect()) == [("apple", [1.0, 0.0]), ("b", [0.5, 0.5])]
    assert vectors.read_json_cache(spark, str(tmp_path / "none.json")).count() == 0


def test_neighbors_with_ties(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)] + [(99, None), (50, [0.0, 0.0])]
    x = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = vectors.nearest(x.where("id in (1, 50)"), x, 3).collect()
    assert sorted((r.a_id, r.rank, r.b_id) for r in got) == [(1, 1, 1), (1, 2, 3), (1, 3, 5), (50, 1, 0), (50, 2, 1), (50, 3, 2)]

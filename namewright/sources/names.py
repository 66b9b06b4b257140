"""Reading lists of names, labels and manual matches; writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from namewright.functions.text import stripped

MANUAL = "matches ARRAY<STRUCT<a_names: ARRAY<STRING>, b_name: STRING, b_id: STRING, created_at: STRING, notes: STRING>>"


def read_names(spark: SparkSession, path: str, name_column: str = "name", id_column: str = "id") -> DataFrame:
    """(id, name): .jsonl as JSON lines, Parquet as such, all else as CSV with a header.

    Names are stripped of white space; null and blank ones go.  Rows without an id have their place as
    one: in JSON lines of any line, in CSV of any record, blank names counted."""
    if path.endswith(".jsonl"):
        field = lambda c: F.get_json_object("value", f"$['{c}']")
        rows = spark.read.text(path)
        chosen = rows.select(field(id_column).cast("long").alias("id"), field(name_column).alias("name"), stripped(F.col("value")).alias("value"))
        if not chosen.where("id is null and value <> ''").isEmpty():
            chosen = _placed(rows.select(F.struct(field(id_column).cast("long").alias("id"), field(name_column).alias("name")).alias("row"))).select(F.coalesce("row.id", "place").alias("id"), "row.name")
        rows = chosen.select("id", "name")
    else:
        rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        if id_column in rows.columns:
            rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(name_column).cast("string").alias("name"))
        else:
            rows = _placed(rows.select(F.struct(F.col(name_column).cast("string").alias("name")).alias("row"))).select(F.col("place").alias("id"), "row.name")
    return rows.withColumn("name", stripped(F.col("name"))).where("name is not null and name <> ''")


def _placed(rows: DataFrame) -> DataFrame:
    """rows (row) with their place in the file; this takes the order of the file's splits."""
    return rows.rdd.zipWithIndex().map(lambda x: (x[1], x[0]["row"])).toDF(f"place long, row {rows.schema['row'].dataType.simpleString()}")


def read_excel(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Columns (source name -> ours) of a workbook, through pandas; needs an Excel engine there."""
    import pandas as pd

    frame = pd.read_excel(path)[list(columns)].rename(columns=columns)
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} string" for c in columns.values()))


def read_labeled_pairs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select(stripped(F.col("name_a")).alias("name_a"), stripped(F.col("name_b")).alias("name_b"), F.col("label").cast("int").alias("label"))


def read_manual(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, a_name, b_name, b_id, notes); a missing or broken file is empty."""
    try:
        doc = spark.read.option("multiLine", True).schema(MANUAL).json(path)
    except AnalysisException:
        doc = spark.createDataFrame([], MANUAL)
    rows = doc.select(F.posexplode("matches").alias("at", "m")).select("at", "m.*", F.posexplode("m.a_names").alias("place", "a_name"))
    return rows.select((F.col("at").cast("long") * 1_000_000 + F.col("place")).alias("ordinal"), "a_name", "b_name", "b_id", F.coalesce("notes", F.lit("")).alias("notes"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).option("escape", '"').csv(path)


def _four(c: str) -> Column:
    return F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.4f", F.col(c).cast("double")))


def csv_rows(results: DataFrame, debug: bool = False) -> DataFrame:
    """results as the strings that a CSV file holds: four places, reasons joined by a bar, null as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    out = [text("a_id"), text("a_name"), text("b_id"), text("b_name"), text("decision"), _four("score").alias("score"), _four("runner_up_score").alias("runner_up_score"), _four("margin").alias("margin"), text("used_llm"), F.array_join("reasons", "|").alias("reasons")]
    if debug:
        out += [F.array_join("warnings", "|").alias("warnings")] * ("warnings" in results.columns) + [F.to_json("top_candidates").alias("top_candidates")]
    return results.select(*out)


def export_rows(results: DataFrame) -> DataFrame:
    """results as exported to reviewers: scores rounded to four places, reasons joined by '; '."""
    more = ["group_size"] if "group_size" in results.columns else []
    return results.select("a_name", *more, "b_name", "b_id", "decision", F.round("score", 4).alias("score"), F.round("runner_up_score", 4).alias("runner_up_score"), F.array_join("reasons", "; ").alias("reasons"))


def in_order(results: DataFrame) -> DataFrame:
    """Manual matches first, the rest after them, each in the order of the input (ids are places)."""
    return results.orderBy(F.col("decision") != "MANUAL_MATCH", "a_id")


def write_results(results: DataFrame, path: str, debug: bool = False) -> None:
    """.jsonl as JSON lines with nulls, Parquet as such, all else as CSV with a header; in order."""
    results = in_order(results)
    if path.endswith(".jsonl"):
        hidden = ["top_candidates", "warnings", "candidate_count"]
        (results if debug else results.drop(*hidden)).write.option("ignoreNullFields", "false").json(path)
    elif path.endswith(".parquet"):
        results.write.parquet(path)
    else:
        csv_rows(results, debug).write.option("header", True).option("escape", '"').csv(path)

"""Cross-site line deduplication by HyperLogLog spread.

Every line (trimmed, hashed to 64 bits) gets a HyperLogLog sketch of the sites it stands on; sketches
merge by aggregation.  Lines whose estimate is clearly over or under the threshold are settled by the
sketch; lines near it get an exact distinct count.  A line that reaches `min_sites` sites is
boilerplate and is cut from every document but the one with the smallest id that holds it: so a text
that was copied to many sites survives once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import fresh, stored

MIN_SITES = 10
#: All lines but empty ones are counted and cut.
MIN_CHARS = 1
LG_K = 12
#: Estimates within this share of the threshold are counted exactly; the sketch's standard error at
#: lg_k 12 is under 2 %, so the band is more than ten errors wide.
BAND = 0.25


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """(rid, id, site, at, h): the lines of rows that may be boilerplate, by their hash."""
    rid = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(rid.alias("rid"), F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
    return rows.where(F.char_length(F.trim("line")) >= min_chars).select("rid", "id", "site", "at", line_hash(F.col("line")).alias("h"))


def boilerplate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, first_id): hashes of lines on at least min_sites sites, with the smallest id that holds each.

    Null sites are no sites; lines of fewer than min_chars characters once trimmed are left out.
    """
    lines = _lines(docs, id_col, text_col, site_col, min_chars).select("h", "site", "id")
    spread = lines.groupBy("h").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("id").alias("first_id"))
    # A line that occurs fewer times than min_sites can't stand on so many sites.
    rated = spread.where(F.col("n") >= min_sites).select("h", "first_id", F.hll_sketch_estimate("sketch").alias("sites"))
    rated = stored(rated.where(F.col("sites") >= min_sites * (1 - BAND)), "line-spread")
    sure = rated.where(F.col("sites") > min_sites * (1 + BAND)).select("h", "first_id")
    near = rated.where(F.col("sites") <= min_sites * (1 + BAND)).select("h", "first_id")
    pairs = lines.join(near, "h", "left_semi").select("h", "site").distinct()
    exact = pairs.groupBy("h").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return stored(sure.unionByName(near.join(exact.select("h"), "h", "left_semi")), "line-boilerplate")


def strip_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with boilerplate lines cut from the text, plus n_lines and n_removed (long).

    Null texts stay null with no lines; an empty text has one empty line; repeated rows are treated
    alike; a null id is never a first one; an empty table gives an empty one.  The columns n_lines and
    n_removed replace columns of those names; all others stay, whatever their names.
    """
    bad = boilerplate_lines(docs, id_col, text_col, site_col, min_sites, min_chars)
    hits = _lines(docs, id_col, text_col, site_col, min_chars).join(bad, "h").where(~F.coalesce(F.col("id").eqNullSafe(F.col("first_id")), F.lit(False)))
    row, cut, kept = fresh("rid"), fresh("cut"), fresh("kept")
    cuts = hits.groupBy(F.col("rid").alias(row)).agg(F.collect_set("at").alias(cut))
    lines, text, gone = F.split(F.col(text_col), "\n"), F.col(text_col), F.coalesce(F.size(cut), F.lit(0))
    rows = docs.withColumn(row, F.xxhash64(F.col(id_col), text)).join(cuts.hint("shuffle_hash"), row, "left")

    def left(own: Column) -> Column:
        # array_except hashes, so a row costs its lines, however many are cut.
        places = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(cut))
        return F.array_join(F.transform(places, lambda i: F.get(own, i)), "\n")

    # The transform of an array of one splits the text once, not once a line.
    rows = rows.withColumn(kept, F.when(F.col(cut).isNull(), text).otherwise(F.get(F.transform(F.array(lines), left), 0)))
    counts = {"n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": F.when(F.col(cut).isNull(), 0).otherwise(gone).cast("long")}
    return rows.withColumns(counts).withColumn(text_col, F.col(kept)).drop(row, cut, kept)

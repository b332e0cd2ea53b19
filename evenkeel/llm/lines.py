"""Line dedup by the number of distinct sites that a line stands on."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.sources import materialise

_WORD = r"[^\x20\x09-\x0D]"
#: Standard errors of a sketch within which a line counts as near the threshold.
_ERRORS = 4


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(line: Column) -> Column:
    """Two independent hashes of a line."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def line_sites(docs: DataFrame, site: str = "source") -> DataFrame:
    """(line, site) once per document that holds the line; lines without a word don't count."""
    lines = F.array_distinct(F.filter(_lines(F.col("text")), lambda x: x.rlike(_WORD)))
    return docs.select(F.col(site).cast("string").alias("site"), F.explode(lines).alias("line")).select(_hashes(F.col("line")).alias("line"), "site")


def boilerplate(docs: DataFrame, min_sites: int = 8, lg_k: int = 12, site: str = "source") -> DataFrame:
    """Hashes of the lines that stand on ``min_sites`` distinct sites or more.

    A HyperLogLog sketch of the sites per line is built in each task and merged
    by the aggregation. A line whose estimate is within four standard errors
    (and one) of the threshold is counted exactly; its sites are folded in each task
    before the shuffle, so a line of a third of all documents is no hot key. A null
    site is no site.
    """
    pairs = line_sites(docs, site)
    error = _ERRORS * 1.04 / sqrt(1 << lg_k)
    spread = pairs.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("spread"))
    above = spread.where(F.col("spread") >= min_sites * (1 - error) - 1).select("line", (F.col("spread") > min_sites * (1 + error) + 1).alias("sure"))
    above = materialise(above)  # a small table: Spark can send it to all tasks, or else split a hot line
    near = above.where(~F.col("sure")).select("line")
    exact = pairs.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites"))
    return above.where("sure").select("line").unionByName(exact.where(F.col("sites") >= min_sites).select("line"))


def without_boilerplate(docs: DataFrame, min_sites: int = 8, keep_whole: bool = False, lg_k: int = 12, site: str = "source") -> DataFrame:
    """``docs`` as a struct ``doc``, with ``n_lines``, ``n_removed`` and ``kept``, the text without boilerplate lines.

    Lines are cut at \\n and compared as they stand; those without a word are kept.
    Boilerplate goes from every document. One of which all lines with a word are boilerplate has none of them left;
    ``keep_whole`` leaves such documents as they are, for a later step that looks for copies of whole documents. A null text
    stays null. Rows with the same doc_id and text get the same result.
    """
    held = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("sum"))
    lines = F.array_distinct(F.filter(_lines(F.col("doc.text")), lambda x: x.rlike(_WORD)))
    holds = held.select("id", "sum", F.explode(lines).alias("line")).select("id", "sum", _hashes(F.col("line")).alias("line"))
    bad = materialise(boilerplate(docs, min_sites, lg_k, site))
    hits = holds.join(bad, "line").groupBy("id", "sum").agg(F.collect_set("line").alias("bad"))
    hits = hits.select(F.col("id").alias("hit_id"), F.col("sum").alias("hit_sum"), "bad")
    joined = held.join(hits, held["id"].eqNullSafe(hits["hit_id"]) & (held["sum"] == hits["hit_sum"]), "left")
    cut = joined.select("doc", "bad", _lines(F.col("doc.text")).alias("lines"))
    good = cut.select(
        "doc",
        "lines",
        F.size(F.filter("lines", lambda x: x.rlike(_WORD))).alias("n_lines"),
        F.when(F.col("bad").isNotNull(), F.filter("lines", lambda x: ~F.array_contains("bad", _hashes(x)))).otherwise(F.col("lines")).alias("left"),
    )
    gone = F.size("lines") - F.size("left")
    whole = (gone == F.col("n_lines")) if keep_whole else F.lit(False)
    return good.select(
        "doc",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(gone).cast("long").alias("n_removed"),
        F.when(F.col("doc.text").isNull() | whole | (gone == 0), F.col("doc.text")).otherwise(F.array_join("left", "\n")).alias("kept"),
    )


def line_dedup(docs: DataFrame, min_sites: int = 8, keep_whole: bool = False, lg_k: int = 12, site: str = "source") -> DataFrame:
    """The rows of ``docs`` with boilerplate lines taken out of ``text`` (and ``n_chars`` brought up to date), as
    ``without_boilerplate`` does."""
    done = without_boilerplate(docs, min_sites, keep_whole, lg_k, site)
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    kinds = dict(docs.dtypes)
    return done.select(*((new[c].cast(kinds[c]) if new.get(c) is not None else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every row; a null text counts as empty."""
    return without_boilerplate(docs).select(
        "doc.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )

"""Secret scans over an incremental ledger of blobs.

Every historical version of a text is addressed by the SHA-256 of its content. A
ledger remembers which rules (with their versions) each blob was scanned by
and what was found; a scan reads only blobs with rules not yet applied, whatever
paths they stand at, and joins the findings back to all paths.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.sources import materialise

_LEDGER = "blob string, rules array<string>, findings array<struct<rule:string,kind:string,start:long,end:long>>"
_FINDING = pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


class Rule(NamedTuple):
    """A kind of secret. A match counts if its ``group`` has ``least`` characters. ``hints``: one of them is in
    the lower-case text of every match. A change of the rule takes a new ``version``."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three patterns. Kinds are listed in the order of the result.
RULES = (
    Rule(
        "assign", 1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 12, ("password", "passwd", "secret", "token", "api_key", "apikey"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, ("eyj",)),
    Rule("hub_token", 1, r"\bgh[oprsu]_[A-Za-z0-9]{36,}", 0, 1, ("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("url_login", 1, r"\b[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]{6,}@[A-Za-z0-9.-]+", 0, 1, ("://",)),
)


def blob_of(text: Column) -> Column:
    """Address of a text's content; a null text is empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _found(rules: list[Rule]):
    """A function from a text to its findings by some of ``rules``, in code points."""
    compiled = {r.key: (r, re.compile(r.pattern)) for r in rules}
    # Runs shorter than the least length can't count where the pattern is one run of a class.
    for key, (r, _) in compiled.items():
        if re.fullmatch(r"\[[^\]]*\]\+", r.pattern):
            compiled[key] = (r, re.compile(f"{r.pattern[:-1]}{{{r.least},}}"))

    def scan(text: str, todo: list[str]) -> list[dict]:
        low, out = text.lower(), []
        for key in todo:
            r, pattern = compiled[key]
            if r.hints and not any(h in low for h in r.hints):
                continue
            for m in pattern.finditer(text):
                if m.end(r.group) - m.start(r.group) >= r.least:
                    out.append({"rule": key, "kind": r.kind, "start": m.start(), "end": m.end()})
        return out

    return scan


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the blobs of ``versions`` by the rules that they have not been scanned by, and append to ``ledger``.

    ``ledger`` is a Parquet folder, made if there is none. Each run appends one folder when it
    succeeds, so a failed run leaves nothing and a repeated one finds nothing to do. Two runs at the same time
    may both scan a blob; their findings are equal and folded by the reader. Copies are folded in each task before the shuffle.
    """
    spark = versions.sparkSession
    keys = F.array(*(F.lit(r.key) for r in rules))
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    seen = read_ledger(spark, ledger)
    if seen is not None:
        done = seen.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        blobs = blobs.join(done, "blob", "left").select("blob", "text", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
    else:
        blobs = blobs.select("blob", "text", keys.alias("todo"))
    listed = list(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _found(listed)
        for batch in batches:
            todo = batch.column("todo").to_pylist()
            found = [find(t.as_py(), r) for t, r in zip(batch.column("text"), todo, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), pa.array(todo, pa.list_(pa.string())), pa.array(found, pa.list_(_FINDING))],
                names=["blob", "rules", "findings"],
            )

    blobs.where(F.size("todo") > 0).mapInArrow(scan, _LEDGER).write.parquet(f"{ledger}/run={uuid.uuid4().hex}")


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """(blob, rules, findings) of all runs, or None before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"{_LEDGER}, run string").parquet(ledger).drop("run")


def scan_secrets(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` as a struct ``doc`` with ``spans``, the findings of its text: (start, at, kind, end), sorted.

    ``at`` is the place of the kind among ``rules``. A null text is empty. Every row gets
    its blob's findings, so copies under many paths are scanned once. The input's columns can't clash.
    """
    update_ledger(versions, ledger, rules)
    keys = [r.key for r in rules]
    found = read_ledger(versions.sparkSession, ledger).select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin(keys))
    at = F.array_position(F.array(*(F.lit(k) for k in keys)), F.col("f.rule"))
    span = F.struct(F.col("f.start").alias("start"), at.alias("at"), F.col("f.kind").alias("kind"), F.col("f.end").alias("end"))
    # A set, since two runs at the same time leave a blob's findings twice; written, so that the join can split a hot blob's rows.
    by_blob = materialise(found.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("spans")))
    held = versions.select(F.struct("*").alias("doc"), blob_of(F.col("text")).alias("blob"))
    return held.join(by_blob, "blob", "left").select("doc", "blob", F.coalesce("spans", F.array().cast(by_blob.schema["spans"].dataType)).alias("spans"))


def digest(versions: DataFrame, ledger: str) -> DataFrame:
    """The contract's columns of :func:`scan_secrets`."""
    slim = versions.select("doc_id", "text")
    found = scan_secrets(slim, ledger).select("doc.doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))

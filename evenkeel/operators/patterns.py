"""Names against a table of patterns, joined by equality.

Each pattern stands under one key that every name it matches must have: characters at a fixed distance from the beginning or
the end (next to no %), or a run of up to three characters anywhere, whichever the fewest names have. Names are
listed under the forms of such keys that are asked for (which distance, how many characters), and only names and patterns that
share a key are compared. Patterns without any literal stand under the lengths that they allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.sources import materialise

#: Farthest place of a fixed run and longest run at an end, characters of any other run, lengths told apart.
_REACH, _GRAM, _LENGTHS = 16, 3, 64


def _none() -> Column:
    return F.array().cast("array<string>")


def _key(form: Column, literal: Column) -> Column:
    return F.concat(form, F.lit(":"), F.length(literal).cast("string"), F.lit("="), literal)


def _floating(piece: Column) -> Column:
    """Keys of a literal that can stand anywhere: its runs of three characters, or itself."""
    n = F.least(F.length(piece), F.lit(_GRAM))
    starts = F.sequence(F.lit(1), F.length(piece) - n + 1)
    return F.when(n > 0, F.transform(starts, lambda k: _key(F.lit("*"), F.substring(piece, k, n)))).otherwise(_none())


def _fixed(part: Column, side: str) -> Column:
    """Keys of the literals near the outer end of what stands before the first % (side <) or after the last one (side >)."""
    length, gram = F.length(part), F.lit(_GRAM)
    end = F.regexp_extract(part, f"^[^_]{{1,{_REACH}}}" if side == "<" else f"[^_]{{1,{_REACH}}}\\z", 0)
    first = F.lit(1) if side == "<" else F.greatest(F.lit(1), length - (_REACH - 1))
    last = F.least(length, F.lit(_REACH)) if side == "<" else length

    def at(p: Column) -> Column:
        run = F.regexp_extract(F.substring(part, p, gram), "^[^_]*", 0)
        starts = (p == 1) | (F.substring(part, p - 1, F.lit(1)) == "_")
        place = p if side == "<" else length - p + 1
        beyond = place > F.length(end)  # the end as a whole is rarer than its parts
        return F.when(beyond & ((F.length(run) == gram) | (F.length(run) > 0) & starts), _key(F.concat(F.lit(side), place.cast("string")), run))

    place = F.lit(1) if side == "<" else F.length(end)
    whole = F.when(F.length(end) > 0, _key(F.concat(F.lit(side), place.cast("string")), end))
    runs = F.when(length > 0, F.transform(F.sequence(first, last), at)).otherwise(_none())
    return F.array_compact(F.array_append(runs, whole))


def _pattern_keys(patterns: DataFrame) -> DataFrame:
    """(pattern, open, key): the keys to choose from of patterns with literals, and all keys of those without."""
    plain = F.regexp_replace(F.lower("pattern"), r"\\.", "_")
    made = patterns.select(F.col("pattern").cast("string").alias("pattern")).filter(F.col("pattern").isNotNull()).distinct()
    made = made.withColumn("_plain", plain).withColumn("_parts", F.split("_plain", "%")).withColumn("_n", F.size("_parts"))
    made = made.withColumn("_head", F.element_at("_parts", 1)).withColumn("_tail", F.when(F.col("_n") > 1, F.element_at("_parts", -1)).otherwise(""))
    inner = F.when(F.col("_n") > 2, F.slice("_parts", F.lit(2), F.col("_n") - 2)).otherwise(_none())
    far = F.array(F.substring("_head", _REACH + 1, 2**30), F.expr(f"substring(_tail, 1, greatest(length(_tail) - {_REACH}, 0))"))
    pieces = F.flatten(F.transform(F.concat(inner, far), lambda part: F.split(part, "_")))
    literal = F.concat(_fixed(F.col("_head"), "<"), _fixed(F.col("_tail"), ">"), F.flatten(F.transform(pieces, _floating)))
    longer = F.filter(literal, lambda key: ~F.startswith(key, F.lit("*:1=")))  # one character anywhere is rarely rare
    literal = F.when(F.size(longer) > 0, longer).otherwise(literal)
    least = F.least(F.length(F.replace("_plain", F.lit("%"), F.lit(""))), F.lit(_LENGTHS))
    lengths = F.when(F.col("_n") > 1, F.sequence(least, F.lit(_LENGTHS))).otherwise(F.array(least))
    open_ = F.length(F.regexp_replace("_plain", "[%_]", "")) == 0
    keys = F.when(open_, F.transform(lengths, lambda n: F.concat(F.lit("#="), n.cast("string")))).otherwise(F.array_distinct(literal))
    return made.select("pattern", open_.alias("_open"), F.explode(keys).alias("_key"))


def _forms(keys: DataFrame) -> list[str]:
    """The forms of the keys that are asked for: 126 at most, however many the keys."""
    return sorted(r[0] for r in keys.select(F.substring_index("_key", "=", 1)).distinct().collect())


def _listed(names: DataFrame, forms: list[str]) -> DataFrame:
    """The names once for each of their keys in some forms. ``names`` have the text in _text, which is left out."""
    text, at = F.col("_text"), F.col("_at")
    grams, fixed = [], []
    for form in forms:
        if form == "#":
            fixed.append(F.concat(F.lit("#="), F.least(F.length(text), F.lit(_LENGTHS)).cast("string")))
            continue
        place, n = form.split(":")[0], int(form.split(":")[1])
        if place == "*":
            run = F.substring(text, at, F.lit(n))
            grams.append(F.when((F.length(run) == n) & (F.instr(text, run) == at), F.concat(F.lit(f"{form}="), run)))  # where it is first
            continue
        p = int(place[1:])
        start, least = (p, p + n - 1) if place[0] == "<" else (-p, p)
        fixed.append(F.when(F.length(text) >= least, F.concat(F.lit(f"{form}="), F.substring(text, start, n))))
    all_, later = (F.array(*keys).cast("array<string>") for keys in (fixed + grams, grams))
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))) if grams else F.array(F.lit(1))
    placed = names.select("*", F.explode(places).alias("_at"))
    kept = [c for c in names.columns if c != "_text"]
    return placed.select(*kept, F.explode(F.when(at == 1, all_).otherwise(later)).alias("_key")).filter(F.col("_key").isNotNull())


def match_patterns(relations: DataFrame, patterns: DataFrame, name: str = "name", folder: str | None = None) -> DataFrame:
    """The rows of ``relations`` once for each ``pattern`` of ``patterns`` that the name matches as a whole, whatever its case.

    In a pattern % stands for any text, _ for any one character, and a backslash takes the next
    character as it is. Equal patterns count once; NULL patterns match nothing, nor do NULL names. Repeated
    relations stay. Rows of ``relations`` may not have a column ``pattern`` (raises).

    The key of a pattern is the one that the fewest names have, counted over all names, so patterns that share a common beginning
    are told apart by what else they ask for. All patterns with one key and no other literal are compared with the same names:
    that is the size of the result, up to what their wildcards reject. The patterns with their keys are stored below ``folder``
    (see ``materialise``); names are dealt out evenly first, as a small file can hold many.
    """
    if "pattern" in relations.columns:
        raise ValueError("relations have a column pattern already")
    keys = materialise(_pattern_keys(patterns), folder)
    chosen = keys.filter("NOT _open").select("pattern", "_key")
    text = F.lower(F.col(f"`{name}`"))
    known = relations.filter(F.col(f"`{name}`").isNotNull())
    parts = int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = chosen.select("_key").distinct()
    named = _listed(known.select(text.alias("_text")).repartition(parts), _forms(chosen))
    counts = named.join(asked, "_key", "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    rare = F.min_by("_key", F.struct(F.coalesce("_n", F.lit(0).cast("long")), "_key")).alias("_key")
    best = chosen.join(counts, "_key", "left").groupBy("pattern").agg(rare).select("pattern", "_key")
    best = materialise(best.unionByName(keys.filter("_open").select("pattern", "_key")), folder)
    rows = known.select(F.struct(*(F.col(f"`{c}`") for c in relations.columns)).alias("_row"), text.alias("_text")).repartition(parts)
    met = _listed(rows, _forms(best)).join(best, "_key")
    return met.filter(F.ilike(F.col(f"_row.`{name}`"), F.col("pattern"))).select("_row.*", "pattern")

"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question asked again with
other values has the same template. Windows of template tokens are joined by hash;
where they match, the values in the slots of one aligned copy must map one to one.
A name is told by its capital, so a copy in other case has other names: windows in which
names stand as words are looked up as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.sources import materialise

_TOKEN = r"[\p{L}\p{N}]+(?:[.,:/'’-][\p{L}\p{N}]+)*[.!?]*"
#: Placeholders, which no token can be.
NUMBER, UNIT, NAME = "#n", "#u", "#p"
#: Words for numbers, and units.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
UNITS = (
    "cm dm feet foot gallons grams hectares hours inches joules kg kilograms kilometers kilometres km kmh kph kwh liters litres mb gb tb "
    "meters metres miles millimeters minutes mm mph newtons ounces percent pounds seconds tons tonnes volts watts weeks yards years "
    "cents dollars euros pence"
).split()
#: Most bytes of distinct window hashes that are sent to every task; more are joined by a shuffle.
_SENT_BYTES = 32 << 20


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def _values(tokens: str) -> Column:
    """What stands at each place: lower case, without the end of a sentence."""
    return F.transform(tokens, lambda t: F.lower(F.rtrim(t, F.lit(".!?"))))


def _template(tokens: str, values: str) -> Column:
    """A placeholder for each number, unit and name (a capital word that begins no sentence), else the value."""

    def typed(v: Column, i: Column) -> Column:
        t, before = F.get(tokens, i), F.get(tokens, i - 1)
        middle = before.isNotNull() & ~before.rlike("[.!?]$")
        return (
            F.when(v.rlike(r"^\p{N}") | v.isin(*NUMBER_WORDS), F.lit(NUMBER))
            .when(v.isin(*UNITS), F.lit(UNIT))
            .when(t.rlike(r"^\p{Lu}") & middle, F.lit(NAME))
            .otherwise(v)
        )

    return F.transform(values, typed)


def _cased(template: str, values: str) -> Column:
    """The template of a text whose capitals say nothing: names stand as words."""
    return F.zip_with(template, values, lambda k, v: F.when(k == NAME, v).otherwise(k))


def _hashes(template: str, size: int) -> Column:
    """Hash of each run of ``size`` template tokens."""
    run = F.transform(F.sequence(F.lit(0), F.size(template) - size), lambda i: F.xxhash64(*(F.get(template, i + k) for k in range(size))))
    return F.when(F.size(template) >= size, run).otherwise(F.array().cast("array<bigint>"))


def _cased_hashes(template: str, cased: str, size: int) -> Column:
    """Hashes of ``cased`` for the windows that hold a name; those of the others are the same as without."""
    last = F.size(template) - size
    names = F.filter(F.sequence(F.lit(0), F.size(template) - 1), lambda i: F.get(template, i) == NAME)
    places = F.array_distinct(F.flatten(F.transform(names, lambda i: F.sequence(F.greatest(i - (size - 1), F.lit(0)), F.least(i, last)))))
    run = F.transform(places, lambda i: F.xxhash64(*(F.get(cased, i + k) for k in range(size))))
    return F.when(F.size(template) >= size, run).otherwise(F.array().cast("array<bigint>"))


def _templates(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, values, template, cased) of every text; each layer is used twice above, so it is computed once."""
    tokens = texts.select(*keys, _tokens(F.col("text")).alias("tokens"))
    typed = tokens.select(*keys, "tokens", _values("tokens").alias("values")).select(*keys, "values", _template("tokens", "values").alias("template"))
    return typed.select(*keys, "values", "template", _cased("template", "values").alias("cased"))


def _windows(templates: DataFrame, size: int, *keys: str, only: DataFrame | None = None, forms: tuple[str, ...] = ("template", "cased")) -> DataFrame:
    """(keys, kind, hash, at, template, values) of every window, of kind 0 with names as placeholders, of kind 1 with names as words
    and, if ``forms`` has the values too, of kind 2 without placeholders.

    With ``only``, of the windows with its hashes, so that others are not cut out and sent through a shuffle.

    The generator is an outer one, since Spark would test an inner one's array in a filter below the projections
    and compute all templates once per window there.
    """
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("template")) for k, c in enumerate(forms)))
    both = templates.select(*keys, "values", F.explode(kinds).alias("of")).select(*keys, "values", "of.*")
    placed = both.select(*keys, "kind", "values", "template", F.posexplode_outer(_hashes("template", size)).alias("at", "hash")).where("hash IS NOT NULL")
    if only is not None:
        placed = placed.join(only, "hash", "left_semi")
    return placed.select(*keys, "kind", "hash", "at", F.slice("template", F.col("at") + 1, size).alias("template"), F.slice("values", F.col("at") + 1, size).alias("values"))


def _longest(places: Column, size: int) -> Column:
    """Most tokens in a row that windows at sorted ``places`` cover."""
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("stop"), F.lit(0).alias("best"))

    def step(run: Column, at: Column) -> Column:
        start = F.when(at <= run["stop"], run["start"]).otherwise(at)
        return F.struct(start.alias("start"), (at + size).alias("stop"), F.greatest(run["best"], at + size - start).alias("best"))

    return F.aggregate(places, none, step, lambda run: run["best"])


def _literal(template: Column) -> Column:
    return F.size(F.filter(template, lambda t: ~t.isin(NUMBER, UNIT, NAME)))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 8, percent: int = 30, slot_percent: int = 80, run: int = 13) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, n_windows, n_slots, n_changed.

    A window is ``size`` template tokens; an item with fewer tokens is one window. Windows
    in which less than half the tokens are literal say too little as templates and are not looked for; an item that has no other (a
    row of numbers or names) is looked for by its values instead, in any case. Items are looked for twice, with names as slots
    and, for copies in other case, with names as words; what the first finds is reported. An alignment of
    the two counts if at least ``slot_percent`` of the item's slot values there map to one value only. A document
    holds an item if one alignment has at least ``percent`` of the item's windows or ``run`` tokens in a row (a passage of
    a long item), or if all together have ``percent`` of the windows (words added or left out shift the rest). ``n_slots``
    counts the distinct slot values of the best alignment, or of all if none is enough by itself, ``n_changed`` those
    that differ in the document (0: a verbatim copy).

    Null texts and texts without tokens match nothing; rows without doc_id or item_id match nothing; repeated
    rows count once. Other columns are not read.
    """
    items = _templates(benchmark.where("item_id IS NOT NULL").select("item_id", "text"), "item_id")
    items = items.where(F.size("template") > 0).withColumn("size", F.least(F.size("template"), F.lit(size)))
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # at most ``size`` of them
    key = ["doc_id", "item_id", "kind"]
    hits = None
    for s in sorted(sizes):
        sized = items.where(F.col("size") == s)
        own = materialise(_windows(sized, s, "item_id").where(2 * _literal(F.col("template")) >= s).distinct())
        forms = ("template", "cased")
        plain = sized.join(own.select("item_id").distinct(), "item_id", "left_anti")
        if plain.limit(1).count():
            forms = ("template", "cased", "values")
            own = materialise(own.unionByName(_windows(plain, s, "item_id", forms=forms).where("kind = 2").distinct()))
        held = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("sum"), "text")
        hashes = own.select("hash").distinct()
        if hashes.count() * 16 <= _SENT_BYTES:
            hashes = F.broadcast(hashes)
        # First the documents with any window, without their texts in the join; then the windows of those alone.
        parts = [_hashes("template", s), _cased_hashes("template", "cased", s)] + ([_hashes("values", s)] if "values" in forms else [])
        all_windows = _templates(held, "doc_id", "sum").select("doc_id", "sum", F.concat(*parts).alias("hashes"))
        touched = all_windows.select("doc_id", "sum", F.explode_outer("hashes").alias("hash")).join(hashes, "hash", "left_semi").select("doc_id", "sum").distinct()
        touched = materialise(touched)
        again = _windows(_templates(held.join(touched, ["doc_id", "sum"], "left_semi"), "doc_id"), s, "doc_id", only=hashes, forms=forms)
        mine = own.select("kind", "hash", "item_id", F.col("at").alias("item_at"), F.col("template").alias("item_template"), F.col("values").alias("item_values"))
        met = again.join(mine, ["kind", "hash"]).where(F.col("template") == F.col("item_template"))
        total = own.groupBy("item_id", "kind").agg(F.count_distinct("at").alias("total"))
        slots = F.filter(F.arrays_zip("template", "item_values", "values"), lambda x: x["template"].isin(NUMBER, UNIT, NAME))
        aligned = materialise(met.select(*key, (F.col("at") - F.col("item_at")).alias("shift"), "item_at", slots.alias("slots")))
        counts = aligned.groupBy(*key, "shift").agg(F.sort_array(F.collect_set("item_at")).alias("places"))
        pairs = aligned.select(*key, "shift", F.explode("slots").alias("slot")).select(*key, "shift", F.col("slot.item_values").alias("asked"), F.col("slot.values").alias("given"))
        values = pairs.groupBy(*key, "shift", "asked").agg(F.min("given").alias("low"), F.max("given").alias("high"))
        changed = F.count_if((F.col("low") != F.col("asked")) | (F.col("high") != F.col("asked"))).alias("n_changed")
        consistent = values.groupBy(*key, "shift").agg(F.count("*").alias("n_slots"), F.count_if(F.col("low") != F.col("high")).alias("n_mixed"), changed)
        good = counts.join(consistent, [*key, "shift"], "left").join(total, ["item_id", "kind"]).na.fill(0, ["n_slots", "n_mixed", "n_changed"])
        good = good.where(100 * (F.col("n_slots") - F.col("n_mixed")) >= slot_percent * F.col("n_slots"))
        good = materialise(good.select(*key, "shift", "places", F.size("places").cast("long").alias("n_windows"), "n_slots", "n_changed", "total"))
        enough = 100 * F.col("n_windows") >= percent * F.col("total")
        alone = good.where(enough | (_longest(F.col("places"), s) >= run)).select(*key, "shift", "n_windows", "n_slots", "n_changed", F.lit(1).alias("alone"))
        # Pieces of a copy at several shifts, of which none is enough by itself.
        united = good.select(*key, "total", F.explode("places").alias("place")).groupBy(*key, "total").agg(F.count_distinct("place").alias("n_windows")).where(enough)
        all_values = values.join(good, [*key, "shift"], "left_semi").groupBy(*key, "asked").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        all_slots = all_values.groupBy(*key).agg(F.count("*").alias("n_slots"), changed)
        united = united.join(all_slots, key, "left").na.fill(0, ["n_slots", "n_changed"])
        found = alone.unionByName(united.select(*key, F.lit(0).cast("int").alias("shift"), "n_windows", "n_slots", "n_changed", F.lit(0).alias("alone")))
        best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_windows", "n_slots", "n_changed"), F.struct("alone", -F.col("kind"), "n_windows", -F.col("n_changed"), -F.col("shift"))).alias("best"))
        rows = best.select("doc_id", "item_id", "best.n_windows", "best.n_slots", "best.n_changed")
        hits = rows if hits is None else hits.unionByName(rows)
    if hits is None:
        return docs.select("doc_id").limit(0).selectExpr("doc_id", "CAST(0 AS BIGINT) AS item_id", "CAST(0 AS BIGINT) AS n_windows", "CAST(0 AS BIGINT) AS n_slots", "CAST(0 AS BIGINT) AS n_changed")
    return hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 8, percent: int = 30, slot_percent: int = 80, run: int = 13) -> DataFrame:
    """The rows of ``docs`` in which no item of ``benchmark`` is found; rows without doc_id stay."""
    held = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"))
    bad = contaminated(docs, benchmark, size, percent, slot_percent, run).select(F.col("doc_id").alias("bad")).distinct()
    return held.join(bad, held["id"] == bad["bad"], "left_anti").select("doc.*")

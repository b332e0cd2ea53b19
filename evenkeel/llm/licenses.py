"""License scans by ordered signature rules.

A text that has a word of a license at all is brought to lower-case words with single
blanks. A rule is a regular expression over these words behind a keyword: its expression runs only
where the keyword stands. Detections are resolved by containment: one inside a longer one, or with the same
words as one of higher priority, is dropped.
"""

from __future__ import annotations

from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What separates words, as ranges of a character class.
_APART = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OPEN, _CLOSE = "\x01", "\x02"
#: A part of nearly every match: what the gate looks for instead of such a rule's keyword.
_STEM = "licen"


class Rule(NamedTuple):
    """``pattern`` over single-blank lower-case words; ``keyword`` is a part of every match."""

    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


#: Phrases whose places are always reported.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

_V = r"(?: version)?"
_LATER = r"(?: or (?:any )?later(?: version)?)?"
#: Hand-written signatures: label, keyword, name in running text, identifier, address. "-" stands for none.
LICENSES = (
    ("mit", "mit", "mit licen[cs]e", "mit", "opensource org licen[cs]es? mit"),
    ("mit-0", "mit no attribution", "mit no attribution", "mit 0", "opensource org licen[cs]es? mit 0"),
    ("isc", "isc", "isc licen[cs]e", "isc", "opensource org licen[cs]es? isc"),
    ("x11", "x11", "x11 licen[cs]e", "x11", "-"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib", "opensource org licen[cs]es? zlib"),
    ("0bsd", "bsd", "0bsd(?: licen[cs]e)?|zero clause bsd(?: licen[cs]e)?", "0bsd", "opensource org licen[cs]es? 0bsd"),
    ("bsd-2", "bsd", "(?:simplified bsd|freebsd|bsd (?:2|two) clause|(?:2|two) clause bsd) licen[cs]e", "bsd 2 clause", "opensource org licen[cs]es? bsd 2 clause"),
    ("bsd-3", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd (?:3|three) clause|(?:3|three) clause bsd) licen[cs]e", "bsd 3 clause", "opensource org licen[cs]es? bsd 3 clause"),
    ("bsd-4", "bsd", "(?:original bsd|bsd (?:4|four) clause|(?:4|four) clause bsd) licen[cs]e", "bsd 4 clause", "-"),
    ("bsd", "bsd", "bsd(?: style| type)? licen[cs]e", "-", "opensource org licen[cs]es? bsd licen[cs]e"),
    ("apache-1.1", "apache", rf"apache(?: software)? licen[cs]e{_V} 1 1", "apache 1 1", "apache org licen[cs]es? licen[cs]e 1 1"),
    ("apache-2", "apache", rf"apache(?: software)? (?:licen[cs]e{_V} v?2(?: 0)?|2(?: 0)? licen[cs]e)", "apache 2 0", "apache org licen[cs]es? licen[cs]e 2 0"),
    ("gpl-1", "general", rf"(?:gnu )?general public licen[cs]e{_V} v?1(?: 0)?{_LATER}", "gpl 1 0(?: only| or later)?", "gnu org licen[cs]es? (?:old licen[cs]es? )?gpl 1 0"),
    ("gpl-2", "general", rf"(?:gnu )?general public licen[cs]e{_V} v?2(?: 0)?{_LATER}", "gpl 2 0(?: only| or later)?", "gnu org licen[cs]es? (?:old licen[cs]es? )?gpl 2 0"),
    ("gpl-3", "general", rf"(?:gnu )?general public licen[cs]e{_V} v?3(?: 0)?{_LATER}", "gpl 3 0(?: only| or later)?", "gnu org licen[cs]es? gpl 3 0"),
    ("gpl", "general", "gnu general public licen[cs]e", "gpl", "gnu org licen[cs]es? gpl"),
    ("gpl-2", "gplv2", "(?:gnu )?gplv2(?: only| or later)?", "gplv2", "-"),
    ("gpl-3", "gplv3", "(?:gnu )?gplv3(?: only| or later)?", "gplv3", "-"),
    ("lgpl-2", "library", rf"(?:gnu )?library general public licen[cs]e{_V}(?: v?2(?: 0)?)?{_LATER}", "lgpl 2 0(?: only| or later)?", "gnu org licen[cs]es? (?:old licen[cs]es? )?lgpl 2 0"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public licen[cs]e{_V} v?2 1{_LATER}", "lgpl 2 1(?: only| or later)?", "gnu org licen[cs]es? (?:old licen[cs]es? )?lgpl 2 1"),
    ("lgpl-3", "lesser", rf"(?:gnu )?lesser general public licen[cs]e{_V} v?3(?: 0)?{_LATER}", "lgpl 3 0(?: only| or later)?", "gnu org licen[cs]es? lgpl 3 0"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e", "lgpl", "gnu org licen[cs]es? lgpl"),
    ("agpl-3", "affero", rf"(?:gnu )?affero general public licen[cs]e(?:{_V} v?3(?: 0)?)?{_LATER}", "agpl 3 0(?: only| or later)?", "gnu org licen[cs]es? agpl 3 0"),
    ("gfdl", "documentation", rf"(?:gnu )?free documentation licen[cs]e(?:{_V} 1 [0-3])?{_LATER}", "gfdl 1 [0-3](?: only| or later)?", "gnu org licen[cs]es? fdl"),
    ("mpl-1", "mozilla", rf"mozilla public licen[cs]e{_V} 1 [01]", "mpl 1 [01]", "mozilla org mpl mpl 1 [01]"),
    ("mpl-2", "mozilla", rf"mozilla public licen[cs]e{_V} v?2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1", "eclipse", rf"eclipse public licen[cs]e{_V} v?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2", "eclipse", rf"eclipse public licen[cs]e{_V} v?2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl-1", "cddl", "cddl 1 [01]", "cddl 1 [01]", "opensource org licen[cs]es? cddl 1 0"),
    ("cddl-1", "distribution", rf"common development and distribution licen[cs]e(?:{_V} 1 [01])?", "-", "-"),
    ("cpl-1", "common", rf"common public licen[cs]e(?:{_V} 1 0)?", "cpl 1 0", "opensource org licen[cs]es? cpl 1 0"),
    ("eupl-1.2", "eupl", rf"eupl{_V} v?1 2", "eupl 1 2", "-"),
    ("eupl-1.2", "european", rf"european union public licen[cs]e(?:{_V} v?1 2)?", "-", "joinup ec europa eu software page eupl"),
    ("cecill", "cecill", "cecill(?: [bc])?(?: licen[cs]e)?", "cecill (?:2 [01]|b|c)", "cecill info licen[cs]es?"),
    ("artistic-2", "artistic", rf"artistic licen[cs]e{_V} 2(?: 0)?", "artistic 2 0", "opensource org licen[cs]es? artistic 2 0"),
    ("artistic", "artistic", "(?:perl )?artistic licen[cs]e", "artistic 1 0", "opensource org licen[cs]es? artistic"),
    ("bsl-1", "boost", rf"boost software licen[cs]e(?:{_V} 1 0)?", "bsl 1 0", "boost org licen[cs]e 1 0 txt"),
    ("unlicense", "unlicense", "the unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "wtfpl(?: version 2)?", "wtfpl", "wtfpl net"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql", "opensource org licen[cs]es? postgresql"),
    ("python-2", "python", rf"python software foundation licen[cs]e(?:{_V} 2)?", "(?:python|psf) 2 0", "docs python org 3 licen[cs]e"),
    ("ruby", "ruby", "ruby licen[cs]e", "ruby", "-"),
    ("php-3", "php", rf"php licen[cs]e(?:{_V} 3(?: 0[01])?)?", "php 3 0[01]?", "php net licen[cs]e"),
    ("ofl-1.1", "font", rf"(?:sil )?open font licen[cs]e(?:{_V} 1 1)?", "ofl 1 1", "scripts sil org ofl"),
    ("odbl-1", "database", r"open (?:data commons )?(?:open )?database licen[cs]e", "odbl 1 0", "opendatacommons org licen[cs]es? odbl"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", "ms pl", "opensource org licen[cs]es? ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", "ms rl", "opensource org licen[cs]es? ms rl"),
    ("upl-1", "universal", rf"universal permissive licen[cs]e(?:{_V} 1 0)?", "upl 1 0", "oss oracle com licen[cs]es? upl"),
    ("ncsa", "illinois", "university of illinois ncsa open source licen[cs]e", "ncsa", "opensource org licen[cs]es? ncsa"),
    ("busl-1.1", "business", rf"business source licen[cs]e(?:{_V} 1 1)?", "busl 1 1", "mariadb com bsl11"),
    ("sspl-1", "server", rf"server side public licen[cs]e(?:{_V} 1)?", "sspl 1 0", "mongodb com licensing server side public licen[cs]e"),
    ("elastic-2", "elastic", rf"elastic licen[cs]e(?:{_V} 2(?: 0)?)?", "elastic 2 0", "elastic co licensing elastic licen[cs]e"),
    ("cc0", "cc0", rf"cc0(?: 1 0)?(?: universal)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", "-", "creativecommons org licen[cs]es? by [1-4] [05]"),
    ("cc-by", "cc by", "cc by(?: [1-4] [05])?", "cc by [1-4] [05]", "-"),
    ("cc-by-sa", "attribution share", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", "-", "creativecommons org licen[cs]es? by sa"),
    ("cc-by-sa", "cc by", "cc by sa(?: [1-4] [05])?", "cc by sa [1-4] [05]", "-"),
    ("cc-by-nc", "attribution non", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", "-", "creativecommons org licen[cs]es? by nc"),
    ("cc-by-nc", "cc by", "cc by nc(?: [1-4] [05])?", "cc by nc [1-4] [05]", "-"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: [1-4] [05])?", "cc by nc sa [1-4] [05]", "creativecommons org licen[cs]es? by nc sa"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd(?: [1-4] [05])?", "cc by nc nd [1-4] [05]", "creativecommons org licen[cs]es? by nc nd"),
    ("cc-by-nd", "cc by", "cc by nd(?: [1-4] [05])?", "cc by nd [1-4] [05]", "creativecommons org licen[cs]es? by nd"),
    ("public-domain", "public domain", "(?:in|into|to) the public domain", "-", "-"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", "-", "-"),
)
_GRANT = r"(?:licen[cs]ed|released|distributed|available|provided|published|covered|redistributed?) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{})"


def _rules() -> tuple[Rule, ...]:
    """Each license as named, granted, tagged and addressed; an identifier alone is no evidence, so it needs its tag."""
    out = []
    for label, keyword, name, tag, address in LICENSES:
        if name != "-":
            out.append(Rule(label, keyword, name, 2, 0.8))
            if label not in ("public-domain", "all-rights-reserved"):
                out.append(Rule(label, keyword, _GRANT.format(name), 3, 1.0))
        if tag != "-":
            out.append(Rule(label, "spdx", f"spdx licen[cs]e identifier (?:{tag})", 5, 1.0))
            out.append(Rule(label, "license", f"license (?:is )?(?:{tag})", 1, 0.6))
        if address != "-":
            out.append(Rule(label, " ".join(address.split()[:2]), f"(?:www )?(?:{address})", 4, 0.9))
    return (*out, *(Rule("unknown", k, f"{k} under (?:the )?(?:terms of )?[a-z0-9]+", 0, 0.3) for k in ("licensed", "licenced")))


RULES = _rules()


def _always(tree, part: str) -> bool:
    """Whether every match of a parsed expression contains ``part``; False where that can't be told."""
    run = ""
    for op, arg in tree:
        run = run + chr(arg) if op is parser.LITERAL else ""
        if (
            part in run
            or (op is parser.SUBPATTERN and _always(arg[-1], part))
            or (op is parser.BRANCH and all(_always(b, part) for b in arg[1]))
            or (op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[0] > 0 and _always(arg[2], part))
        ):
            return True
    return False


def _gate(rules: tuple[Rule, ...]) -> str:
    """An expression that every text with a match of a rule (or a phrase) meets before it is brought to words."""
    patterns = [*((phrase, phrase) for _, phrase in PHRASES), *((r.keyword, r.pattern) for r in rules)]
    parts = {_STEM if _always(parser.parse(pattern), _STEM) else keyword for keyword, pattern in patterns}
    least = sorted(p for p in parts if not any(o != p and o in p for o in parts))
    return "(?i)" + "|".join(f"[{_APART}]+".join(p.split(" ")) for p in least)


def _words(text: Column) -> Column:
    """Lower-case words, each with one blank on either side of it."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), f"[{_APART}]+", " ")), F.lit(" "))


def _places(words: Column, pattern: Column, label: Column, base: Column, priority: Column, score: Column) -> Column:
    """Matches of a pattern as word positions: marked in the text, then read off where the marked words stand."""
    marked = F.split(F.regexp_replace(words, F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )")), F.lit(f"{_OPEN}$0{_CLOSE}")), " ")

    def where(mark: str, at_start: bool) -> Column:
        has = (lambda w: F.startswith(w, F.lit(mark))) if at_start else (lambda w: F.endswith(w, F.lit(mark)))
        return lambda w, i: F.when(has(w), i - 1)

    def spans(parts: Column) -> Column:
        starts = F.filter(F.transform(parts, where(_OPEN, True)), lambda x: x.isNotNull())
        ends = F.filter(F.transform(parts, where(_CLOSE, False)), lambda x: x.isNotNull())
        return F.zip_with(
            starts, ends,
            lambda a, b: F.struct(
                a.cast("long").alias("start"), (b + 1).cast("long").alias("end"), priority.alias("priority"),
                label.alias("label"), base.alias("base"), score.alias("score"),
            ),
        )

    return F.flatten(F.transform(F.array(marked), spans))


_SPANS = "array<struct<start:long,end:long,priority:int,label:string,base:boolean,score:double>>"


def _detections(words: str, rules: tuple[Rule, ...]) -> Column:
    """All detections in a text's words, unresolved."""
    kind = "array<struct<label:string,keyword:string,pattern:string,priority:int,score:double,base:boolean>>"
    base = [Rule(label, phrase, phrase, 9, 1.0) for label, phrase in PHRASES]
    table = F.array(*(F.struct(*(F.lit(x) for x in (r.label, r.keyword, r.pattern, r.priority, r.score, i < len(base)))) for i, r in enumerate((*base, *rules)))).cast(kind)
    gated = F.filter(table, lambda r: F.contains(F.col(words), r["keyword"]))
    return F.flatten(F.transform(gated, lambda r: _places(F.col(words), r["pattern"], r["label"], r["base"], r["priority"], r["score"]))).cast(_SPANS)


def license_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Resolved detections of every document: doc_id, n_words, spans (word positions, end exclusive, by start).

    Words are maximal runs of A to Z, a to z, 0 to 9 and characters beyond ASCII, with A to Z in lower case. The places of
    ``PHRASES`` are in the result whatever contains them (``base``). A null text is empty. Rows with equal doc_id and text
    are worked on once and given as often as they came. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    held = docs.select(
        "doc_id",
        F.xxhash64("text").alias("sum"),
        F.regexp_count(text, F.lit(f"[^{_APART}]+")).cast("long").alias("n_words"),
        F.when(text.rlike(_gate(rules)), _words(text)).alias("words"),
    )
    spans = F.when(F.col("words").isNotNull(), _detections("words", rules)).otherwise(F.array().cast(_SPANS))
    key = ["doc_id", "sum", "n_words"]
    rows = held.select(*key, spans.alias("found")).groupBy(*key, "found").agg(F.count("*").alias("copies"))
    each = rows.select(*key, "copies", F.explode_outer("found").alias("f")).select(*key, "copies", "f.*")
    # A text's detections are as few as its words, so one task can hold those of one text.
    order = Window.partitionBy(*key).orderBy("base", "start", F.desc("end"), F.desc("priority"), "label")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(~F.col("base"), F.col("end"))).over(before)
    kept = each.withColumn("inside", ~F.col("base") & F.coalesce(F.col("end") <= reach, F.lit(False)))
    span = F.struct("start", "end", "label", "base", "priority", "score")
    out = kept.groupBy(*key, "copies").agg(F.sort_array(F.collect_list(F.when(F.col("start").isNotNull() & ~F.col("inside"), span))).alias("spans"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_words", "spans")


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns of :func:`license_spans`."""
    base = F.filter("spans", lambda s: s["base"])

    def labels(of: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.transform(of, lambda s: s["label"]))), ",")

    return spans.select(
        "doc_id", "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )

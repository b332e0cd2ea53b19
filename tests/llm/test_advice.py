"""Cases of the second review, each of which the operators once missed."""

from __future__ import annotations

import random
import re
from re import _parser as parser

from evenkeel.llm import licenses, templates
from tests.llm import plain

TEXTS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def test_items_in_other_case(spark):
    """Against a case-blind brute force: whole items in capitals, in lower case, in title case, behind 'Q:'."""
    items = {
        1: "A train leaves the old station with Maria and Sven and Olga, stops near Aachen, and waits there for Peter from Bonn.",
        2: "WHICH OF THE SEVEN OLD TOWNS BY THE RIVER HAS NO BRIDGE AND NO FERRY AT ALL",
        3: "Maria met Sven",
        4: "Nothing of this one stands in any of the documents that are looked through here",
    }
    shapes = (str, str.upper, str.lower, str.title, lambda t: f"Q: {t}", lambda t: f"he said {t.upper()} to them")
    texts = [f"Some words before. {shape(t)} And more." for k, t in items.items() if k < 4 for shape in shapes]
    texts += ["maria met olga", "A train leaves the old station", ""]

    def plain(t):
        return " " + " ".join(re.findall(r"\w+", t.lower())) + " "

    want = {(d, k) for d, t in enumerate(texts) for k, i in items.items() if plain(i) in plain(t)}
    found = templates.contaminated(spark.createDataFrame(list(enumerate(texts)), TEXTS), spark.createDataFrame(list(items.items()), ITEMS))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert len(want) == 18


def test_passages_and_edited_copies(spark):
    """A passage of a long item, and a copy with a word added in a few places."""
    word = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnprst"]
    items = {1: " ".join(word[k % 175] + "aei"[k // 175] for k in range(250)), 2: " ".join(w + "o" for w in word[:59]), 3: " ".join(w + "u" for w in word[60:100])}
    long, middle, short = (items[k].split() for k in (1, 2, 3))
    edited = " ".join([*short[:10], "xa", *short[10:20], "xb", *short[20:30], "xc", *short[30:]])
    texts = [" ".join(long[100:160]), " ".join(middle[30:50]), edited, " ".join(long[:12]), " ".join(middle[5:17]), " ".join(short[:10]), "xa xb " + " ".join(long[200:213])]
    texts = [f"own words stand here {t} and here again" for t in texts]
    found = templates.contaminated(spark.createDataFrame(list(enumerate(texts)), TEXTS), spark.createDataFrame(list(items.items()), ITEMS)).collect()
    assert {(r.doc_id, r.item_id, r.n_windows) for r in found} == {(0, 1, 53), (1, 2, 13), (2, 3, 12), (6, 1, 6)}


def _match(tree, r):
    """A random text that a parsed expression matches."""
    out = ""
    for op, arg in tree:
        if op is parser.LITERAL:
            out += chr(arg)
        elif op is parser.IN:
            kind, x = r.choice(arg)
            out += chr(x if kind is parser.LITERAL else r.randint(*x))
        elif op is parser.SUBPATTERN:
            out += _match(arg[-1], r)
        elif op is parser.BRANCH:
            out += _match(r.choice(arg[1]), r)
        else:
            assert op is parser.MAX_REPEAT
            out += "".join(_match(arg[2], r) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 2))))
    return out


def test_every_match_meets_gate_and_keyword():
    r, gate = random.Random(11), re.compile(licenses._gate(licenses.RULES))
    for rule in licenses.RULES:
        for _ in range(60):
            words = _match(parser.parse(rule.pattern), r)
            assert re.fullmatch(rule.pattern, words) and rule.keyword in words, (rule, words)
            raw = "".join(r.choice((" ", "-", "/", ".\n")) if c == " " else r.choice((c, c.upper())) for c in words)
            assert gate.search(raw), (rule, raw)


def test_licenses_behind_the_gate(spark):
    texts = {
        "Released under CDDL 1.0": "cddl-1", "0BSD": "0bsd", "zero-clause BSD": "0bsd", "MIT No Attribution": "mit-0", "https://www.mozilla.org/MPL/2.0/": "mpl-2",
        "https://www.eclipse.org/legal/epl-v10.html": "epl-1", "http://scripts.sil.org/OFL": "ofl-1.1", "https://mariadb.com/bsl11/": "busl-1.1",
        "Creative Commons Attribution-Share Alike 4.0": "cc-by-sa", "Creative Commons Attribution-Non Commercial 4.0": "cc-by-nc", "nothing of the kind": "",
    }
    table = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    assert [r.labels for r in sorted(licenses.digest(licenses.license_spans(table)).collect(), key=lambda r: r.doc_id)] == list(texts.values())


def test_license_places_behind_separators(spark):
    texts = ["(c) 2020 under the MIT license", "# License\n\nunder the MIT license", "\n'cc-by-nc'", "\"Apache License, Version 2.0\"", "under the MIT license"]
    found = licenses.digest(licenses.license_spans(spark.createDataFrame(list(enumerate(texts)), TEXTS))).collect()
    want = [(k, *plain.license_base(t)) for k, t in enumerate(texts)]
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == want
    assert [w[3] for w in want] == [2, 1, 0, 0, 0]

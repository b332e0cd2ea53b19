"""One query per operator over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evenkeel.sources import shared_folder

from . import codebooks, collocations, hmm, jaccard, licenses, lines, packing, quality, secrets, sharding, simple8b, substrings, templates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.rlz_spans(table(spark, sf_dir, "documents"), min_words=13))


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/simple8b-{uuid.uuid4().hex}"
    simple8b.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return simple8b.digest(simple8b.read_ids(spark, path))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=80)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.license_spans(table(spark, sf_dir, "documents")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    return secrets.digest(table(spark, sf_dir, "documents"), ledger)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, with_ids=False)


#: Bytes of a shard: small enough that small tables split as well.
SHARD_BYTES = 1 << 20


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), max_words=3, least=10, covered=50, top=2000)


def op12_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.digest(table(spark, sf_dir, "embeddings"), parts=16)


def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(table(spark, sf_dir, "documents"), states=8, rounds=2, least=10)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simple8b": op2_simple8b,
    "op3_quality_rules": op3_quality_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontamination": op5_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_collocations": op11_collocations,
    "op12_codebooks": op12_codebooks,
    "op13_hidden_markov": op13_hidden_markov,
}

#: Words of each document, numbered.
_WORDS = r"""
WORDS AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)
)"""


def _round_of_codebooks(i: int) -> str:
    """The parts' nearest entries in codebook i, and the codebook after that round."""
    return f"""
A{i} AS (
  SELECT r, part, x, min((d, entry)) AS best FROM (
    SELECT r, part, p.x, entry, coalesce(list_sum(list_transform(range(1, len(p.x) + 1), lambda j: (p.x[j] - b.x[j]) * (p.x[j] - b.x[j]))), 0)::BIGINT AS d
    FROM P p JOIN B{i} b USING (part)
  ) GROUP BY r, part, x
),
M{i} AS (
  SELECT part, entry, list((s - (((s % n) + n) % n)) // n ORDER BY j) AS x FROM (
    SELECT part, best[2] AS entry, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS j FROM A{i}) GROUP BY ALL
  ) GROUP BY part, entry
),
B{i + 1} AS (SELECT part, entry, coalesce(m.x, b.x) AS x FROM B{i} b LEFT JOIN M{i} m USING (part, entry))"""


ORACLE = {
    "op1_substring_dedup": f"""
WITH {_WORDS},
W13 AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS seq,
         count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n
  FROM WORDS
),
HIT AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY seq) AS low FROM W13 WHERE n = 13) WHERE low < doc_id
),
GONE AS (SELECT DISTINCT doc_id, pos + k AS pos FROM HIT, (SELECT unnest(range(13)) AS k)),
KEPT AS (
  SELECT w.doc_id, count(*) AS n_words, count(g.pos) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY w.pos) FILTER (g.pos IS NULL), '') AS kept
  FROM WORDS w LEFT JOIN GONE g ON g.doc_id = w.doc_id AND g.pos = w.pos GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN KEPT k ON k.doc_id = d.doc_id""",
    "op3_quality_rules": r"""
WITH D AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
),
WORDS AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM D),
W3 AS (
  SELECT r, pos, count(*) OVER (PARTITION BY r, word, b, c) AS n
  FROM (SELECT r, pos, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM WORDS WINDOW o AS (PARTITION BY r ORDER BY pos))
  WHERE c IS NOT NULL
),
REP AS (SELECT r, count(DISTINCT pos + k) AS n_repeat_words FROM W3, (SELECT unnest(range(3)) AS k) WHERE n > 1 GROUP BY r),
M AS (
  SELECT doc_id, lang, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ('auf', 'das', 'dem', 'den', 'der', 'des', 'die', 'ein', 'eine', 'für', 'im', 'in', 'ist', 'mit', 'nicht',
           'sich', 'und', 'von', 'zu', 'a', 'and', 'as', 'at', 'be', 'by', 'for', 'from', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'this', 'to',
           'was', 'with', 'con', 'de', 'del', 'el', 'en', 'la', 'las', 'los', 'no', 'para', 'por', 'que', 'se', 'su', 'un', 'una', 'y', 'dans', 'du',
           'elle', 'est', 'et', 'le', 'les', 'pas', 'pour', 'qui', 'sur', 'une'))) AS n_stop_words
  FROM D LEFT JOIN REP ON REP.r = D.r
),
F AS (
  SELECT *, list_filter([
    CASE WHEN n_words < 50 THEN 'few_words' END,
    CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 'repeated_words' END,
    CASE WHEN 100 * word_chars < 250 * n_words THEN 'short_words' END,
    CASE WHEN 100 * word_chars > 1200 * n_words THEN 'long_words' END,
    CASE WHEN 100 * n_symbols > 10 * n_words THEN 'symbols' END,
    CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 'repeated_lines' END,
    CASE WHEN 100 * n_stop_words < 2 * n_words AND (lang IS NULL OR lang IN ('de', 'en', 'es', 'fr')) THEN 'stop_words' END
  ], lambda x: x IS NOT NULL) AS f
  FROM M
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, len(f) = 0 AS kept, n_lines, n_stop_words,
       coalesce(array_to_string(f, ','), '') AS failed
FROM F""",
    "op8_line_dedup": r"""
WITH L AS (
  SELECT r, doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
),
BAD AS (SELECT line FROM L WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 8),
C AS (
  SELECT r, doc_id, count(*) FILTER (regexp_matches(L.line, '[^\x20\x09-\x0D]')) AS n_lines, count(BAD.line) AS gone,
         string_agg(L.line, chr(10) ORDER BY pos) FILTER (BAD.line IS NULL) AS kept
  FROM L LEFT JOIN BAD ON BAD.line = L.line GROUP BY r, doc_id
)
SELECT doc_id, n_lines, gone AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM C""",
    "op4_jaccard_join": r"""
WITH RECURSIVE W AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
S AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM W
),
N AS (SELECT doc_id, count(*) AS n FROM S GROUP BY doc_id),
P AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM S x JOIN S y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
L AS (SELECT a, b FROM P JOIN N na ON na.doc_id = a JOIN N nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
R AS (SELECT a AS doc_id, a AS c FROM L UNION SELECT L.b, R.c FROM R JOIN L ON L.a = R.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(r.c, d.doc_id) AS component_id, coalesce(k.k, d.doc_id) AS class_id
FROM documents d LEFT JOIN N ON N.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(c) AS c FROM R GROUP BY doc_id) r ON r.doc_id = d.doc_id
LEFT JOIN (SELECT a, least(a, min(b)) AS k FROM P JOIN N na ON na.doc_id = a JOIN N nb ON nb.doc_id = b WHERE o = na.n AND o = nb.n GROUP BY a) k ON k.a = d.doc_id""",
    "op10_sharding": f"""
WITH B AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
         right(bin(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT)::VARCHAR, 60) AS raw
  FROM documents
),
D AS (SELECT doc_id, bytes, lpad(raw, 60, '0') AS bits FROM B),
N AS (
  SELECT doc_id, bytes, bits, depth, sum(bytes) OVER (PARTITION BY depth, substr(bits, 1, depth)) AS total
  FROM D, (SELECT unnest(range(61)) AS depth)
),
P AS (SELECT doc_id, any_value(bytes) AS bytes, any_value(bits) AS bits, min(depth) AS depth FROM N WHERE total <= {SHARD_BYTES} GROUP BY doc_id)
SELECT doc_id, bytes, substr(bits, 1, depth) AS shard, CAST(depth AS INTEGER) AS depth, false AS oversized FROM P""",
    "op5_decontamination": r"""
WITH T AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[.,:/''’-][\p{L}\p{N}]+)*[.!?]*') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[.,:/''’-][\p{L}\p{N}]+)*[.!?]*') FROM benchmark
),
V AS (SELECT side, id, unnest(t) AS t, generate_subscripts(t, 1) AS pos FROM T),
P AS (
  SELECT side, id, pos, lower(rtrim(t, '.!?')) AS v, t, lag(t) OVER (PARTITION BY side, id ORDER BY pos) AS before FROM V
),
K AS (
  SELECT side, id, pos, v,
    CASE WHEN regexp_matches(v, '^\p{N}') OR v IN ('two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'twenty',
           'thirty', 'forty', 'fifty', 'hundred', 'thousand', 'million') THEN '#n'
         WHEN v IN ('cm', 'dm', 'feet', 'foot', 'gallons', 'grams', 'hectares', 'hours', 'inches', 'joules', 'kg', 'kilograms', 'kilometers', 'kilometres',
           'km', 'kmh', 'kph', 'kwh', 'liters', 'litres', 'mb', 'gb', 'tb', 'meters', 'metres', 'miles', 'millimeters', 'minutes', 'mm', 'mph', 'newtons',
           'ounces', 'percent', 'pounds', 'seconds', 'tons', 'tonnes', 'volts', 'watts', 'weeks', 'yards', 'years', 'cents', 'dollars', 'euros', 'pence') THEN '#u'
         WHEN regexp_matches(t, '^\p{Lu}') AND before IS NOT NULL AND NOT regexp_matches(before, '[.!?]$') THEN '#p'
         ELSE v END AS k
  FROM P
),
N AS (SELECT id AS item_id, least(count(*), 8) AS size FROM K WHERE side = 'b' GROUP BY id),
W8 AS (
  SELECT side, id, pos, list(k) OVER o AS k0, list(CASE k WHEN '#p' THEN v ELSE k END) OVER o AS k1, list(v) OVER o AS vs
  FROM K WINDOW o AS (PARTITION BY side, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
),
W AS (
  SELECT side, id, pos, size, kind, CASE kind WHEN 0 THEN k0[1:size] WHEN 1 THEN k1[1:size] ELSE vs[1:size] END AS ks, vs[1:size] AS vs
  FROM W8, (SELECT DISTINCT size FROM N), (SELECT unnest([0, 1, 2]) AS kind) WHERE len(vs) >= size
),
OWN AS (SELECT w.*, len(list_filter(ks, lambda x: x NOT IN ('#n', '#u', '#p'))) AS literal FROM W w JOIN N ON N.item_id = w.id AND N.size = w.size WHERE side = 'b'),
SAID AS (SELECT id, pos, size, kind, ks, vs FROM OWN WHERE kind < 2 AND 2 * literal >= size),
I AS (SELECT * FROM SAID UNION ALL SELECT id, pos, size, kind, ks, vs FROM OWN WHERE kind = 2 AND id NOT IN (SELECT id FROM SAID)),
TOTAL AS (SELECT id AS item_id, kind, count(*) AS total FROM I GROUP BY ALL),
MET AS (
  SELECT w.id AS doc_id, i.id AS item_id, i.kind, w.pos - i.pos AS shift, i.pos AS place, i.size, i.ks, i.vs AS asked, w.vs AS given
  FROM I i JOIN W w ON w.side = 'd' AND w.size = i.size AND w.kind = i.kind AND w.ks = i.ks
),
V2 AS (
  SELECT doc_id, item_id, kind, shift, a, min(g) AS low, max(g) AS high
  FROM (SELECT doc_id, item_id, kind, shift, unnest(ks) AS k, unnest(asked) AS a, unnest(given) AS g FROM MET) WHERE k IN ('#n', '#u', '#p') GROUP BY ALL
),
Q AS (
  SELECT doc_id, item_id, kind, shift, count(*) AS n_slots, count(*) FILTER (low <> high) AS n_mixed, count(*) FILTER (low <> a OR high <> a) AS n_changed FROM V2 GROUP BY ALL
),
ISLE AS (
  SELECT *, sum(CASE WHEN place <= before + size THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, item_id, kind, shift ORDER BY place) AS isle
  FROM (SELECT DISTINCT doc_id, item_id, kind, shift, size, place, lag(place) OVER (PARTITION BY doc_id, item_id, kind, shift ORDER BY place) AS before FROM MET)
),
C AS (
  SELECT doc_id, item_id, kind, shift, sum(n)::BIGINT AS n_windows, max(longest) AS longest
  FROM (SELECT doc_id, item_id, kind, shift, count(*) AS n, max(place) - min(place) + any_value(size) AS longest FROM ISLE GROUP BY doc_id, item_id, kind, shift, isle) GROUP BY ALL
),
GOOD AS (
  SELECT C.*, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed, total
  FROM C LEFT JOIN Q USING (doc_id, item_id, kind, shift) JOIN TOTAL USING (item_id, kind)
  WHERE 100 * (coalesce(n_slots, 0) - coalesce(n_mixed, 0)) >= 80 * coalesce(n_slots, 0)
),
UNITED AS (
  SELECT doc_id, item_id, kind, count(DISTINCT place) AS n_windows FROM MET JOIN GOOD USING (doc_id, item_id, kind, shift)
  GROUP BY ALL HAVING 100 * count(DISTINCT place) >= 30 * any_value(total)
),
SLOTS AS (
  SELECT doc_id, item_id, kind, count(*) AS n_slots, count(*) FILTER (low <> a OR high <> a) AS n_changed
  FROM (SELECT doc_id, item_id, kind, a, min(low) AS low, max(high) AS high FROM V2 JOIN GOOD USING (doc_id, item_id, kind, shift) GROUP BY ALL) GROUP BY ALL
),
F AS (
  SELECT doc_id, item_id, kind, shift, n_windows, n_slots, n_changed, 1 AS alone FROM GOOD WHERE 100 * n_windows >= 30 * total OR longest >= 13
  UNION ALL
  SELECT doc_id, item_id, kind, 0, n_windows, coalesce(n_slots, 0), coalesce(n_changed, 0), 0 FROM UNITED LEFT JOIN SLOTS USING (doc_id, item_id, kind)
)
SELECT doc_id, item_id, n_windows, n_slots, n_changed FROM F
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY alone DESC, kind, n_windows DESC, n_changed, shift) = 1""",
    "op11_collocations": r"""
WITH PIECES AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
  )
),
GRAMS AS (
  SELECT lang, size, phrase, count(*) AS n FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
    FROM PIECES, (SELECT unnest([1, 2, 3]) AS size)
  ) GROUP BY ALL
),
TOTAL AS (SELECT lang, sum(n)::BIGINT AS n FROM GRAMS WHERE size = 1 GROUP BY lang),
LONGER AS (SELECT *, string_split(phrase, ' ') AS w FROM GRAMS WHERE size > 1 AND n >= 10),
CUTS AS (
  SELECT c.lang, c.phrase, c.n AS a, k, l.n AS l, r.n AS r, (1000000::HUGEINT * c.n * c.n // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM LONGER) c
  JOIN GRAMS l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN GRAMS r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
),
LOWEST AS (SELECT * FROM CUTS QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
HELD AS (
  SELECT lang, phrase, max(n) AS longest FROM (SELECT lang, n, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM LONGER WHERE size = 3)
  GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM LOWEST JOIN TOTAL t USING (lang) LEFT JOIN HELD h USING (lang, phrase)
WHERE longest IS NULL OR 100 * longest < 50 * a QUALIFY rank <= 2000""",
    "op12_codebooks": f"""
WITH K AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  )
),
P AS (SELECT r, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS x FROM K, (SELECT unnest(range(16)) AS part)),
B0 AS (SELECT part, r - 1 AS entry, x FROM P WHERE r <= 64),{_round_of_codebooks(0)},{_round_of_codebooks(1)},{_round_of_codebooks(2)},
CODED AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM A2 GROUP BY r),
BOOKS AS (
  SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM B2)
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM K JOIN CODED USING (r), BOOKS""",
}

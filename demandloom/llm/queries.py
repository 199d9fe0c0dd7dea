"""Registered queries of the training-data operators, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contamination import digest, find_contamination
from .edit_counts import masked_counts
from .frames import read_table
from .hard_negatives import hard_negatives
from .hilbert import sharded
from .host_rules import CAUTION, MAX_HOST_RATE, MAX_STRENGTH, MEASURES, MIN_STRENGTH, judge
from .jaccard import jaccard_components
from .language import learn, predict
from .line_chunks import dedup_lines
from .packing import pack
from .redirects import Rule, judge_urls
from .turn_repair import repair_damaged
from .vector_copies import near_vectors
from .warc import archive_pages


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated runs of line chunks, and what was removed."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts="removed_")


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, hosts being the sources."""
    judged = judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *MEASURES, "base_failed", "kept", "host_rejected")


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight runs of a Hilbert curve over source, language and length, as written."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return sharded(docs, ["source", "lang", "n_chars"]).select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: Fixed rules of the query.
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page, blocks passed on to aliases."""
    judged = judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, by broadcast windows of 13 words."""
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("bench_words").alias("n_words"),
        F.col("bench_hit").alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        digest(F.col("bench_items")).alias("items_sha256"),
        F.col("bench_contaminated").alias("contaminated"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = learn(docs.where(~fold))
    return predict(docs.select("doc_id", "text", fold.alias("held_out")), model).drop("text")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree by 90 in 100."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives, normalised to a gzip member for each record, and read back."""
    read = archive_pages(read_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after masking, by segment trees."""
    return masked_counts(read_table(spark, sf_dir, "documents"))


def packed_digests(docs: DataFrame) -> DataFrame:
    """Pieces of the packed documents, with the checksum of their ids in place of the ids."""
    return pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return packed_digests(read_table(spark, sf_dir, "documents"))


def op11_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of a label whose cosine is 0.98 or more."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    return repair_damaged(read_table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, labels of every seventh moved on."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_host_rules": op2_host_rules,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_language": op6_language,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_warc": op8_warc,
    "op9_edit_counts": op9_edit_counts,
    "op10_packing": op10_packing,
    "op11_vector_copies": op11_vector_copies,
    "op12_turn_repair": op12_turn_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Words and measures of documents; `measured` has one row for each.
MEASURED_SQL = r"""
d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
places AS (SELECT doc_id, unnest(list_zip(ws[1:len(ws) - 2], ws[2:len(ws) - 1], ws[3:], range(1, len(ws) - 1)))
  AS z FROM w WHERE len(ws) > 2),
again AS (SELECT doc_id, z[4] AS i FROM places
  QUALIFY count(*) OVER (PARTITION BY doc_id, z[1], z[2], z[3]) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again)
  GROUP BY doc_id),
measured AS (SELECT w.doc_id, source, len(ws) AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(ws) < 50 OR 100 * coalesce(n, 0) > 50 * len(ws) AS base_failed
  FROM w LEFT JOIN covered USING (doc_id))"""

def _url_parts(url: str) -> str:
    """Host, path and node of `url` in SQL."""
    return rf"""CASE WHEN strpos({url}, '://') > 0 THEN
      translate(regexp_extract(substr({url}, strpos({url}, '://') + 3), '(?s)^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos({url}, '://') > 0 THEN
      regexp_extract(substr({url}, strpos({url}, '://') + 3), '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN strpos({url}, '://') > 0 THEN
      coalesce(nullif(regexp_extract(substr({url}, strpos({url}, '://') + 3), '(?s)^[^/?#]*([^#]*)', 1), ''), '/')
      END AS tail"""


_FITS = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.verdict} {r.name}'"
    for r in sorted(URL_RULES, key=lambda r: -len(r.name))
)


def _least(*ways: str) -> str:
    """The first of some repairs (cost, edits, text) in SQL; null is none."""
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"


def _edit(at: str, cost: str, letter: str, row: str) -> str:
    text = f"{at}.x" + (f" || chr(10) || {row}" if row else "")
    return f"CASE WHEN {at} IS NOT NULL THEN {{'c': {at}.c + {cost}, 'a': {at}.a || '{letter}', 'x': {text}}} END"


def _inserted(*states: str) -> str:
    """The four states after inserts."""
    user = _least(states[2], *(_edit(states[k], "3", "I", "'user:'") for k in (0, 1, 3) if states[k] != "NULL"))
    none = "CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, x VARCHAR))"
    after = _least(states[3], _edit(f"({user})", "3", "I", "'assistant:'"))
    return f"{states[0]} AS p0, {none if states[1] == 'NULL' else states[1]} AS p1, {user} AS p2, {after} AS p3"


def _row_states() -> str:
    """The four states after a row that is deleted, kept or given another role."""
    extra, free = "CASE fault WHEN 't' THEN 3 ELSE 0 END", "fault NOT IN ('b', 'd')"

    def ways(state: int, initial: str, role: str, sources: tuple[int, ...]) -> str:
        out = [_edit(f"p{state}", "4", "D", "")]
        for k in sources:
            kept = _edit(f"p{k}", extra, "K", "role || ':' || text")
            out.append(f"CASE WHEN {free} AND initial = '{initial}' THEN {kept} END")
            if role:
                given = _edit(f"p{k}", f"3 + {extra}", "R", f"'{role}:' || text")
                out.append(f"CASE WHEN {free} THEN {given} END")
        return _least(*out) + f" AS q{state}"

    return ", ".join([ways(0, "", "", ()), ways(1, "s", "", (0,)), ways(2, "u", "user", (0, 1, 3)), ways(3, "a", "assistant", (2,))])


_ROW = _row_states()

SQL: dict[str, str] = {
    "op4_url_filter": rf"""
WITH RECURSIVE tags AS (SELECT url AS source, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM pages WHERE url LIKE '%://%'),
found AS (SELECT source, regexp_extract(tag, '(?is)\b(?:href|url)\s*=\s*["'']?\s*([^"''>\s]+)', 1) AS t FROM tags
  WHERE regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?\s*canonical\b')
  OR regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b')),
based AS (SELECT source, t, regexp_extract(source, '(?s)^(.*?://)', 1) AS scheme, {_url_parts('source')},
  regexp_extract(t, '(?s)^([^?#]*)', 1) AS name, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) AS query FROM found),
placed AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS own, CASE WHEN name LIKE '/%' THEN name
  ELSE regexp_extract(CASE WHEN path = '' THEN '/' ELSE path END, '(?s)^(.*/)', 1) || name END AS beside FROM based),
cut AS (SELECT *, string_split(substr(beside, 2), '/') AS s FROM placed),
urls AS (SELECT DISTINCT source, CASE WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.\-]*://') THEN t
  WHEN t LIKE '//%' THEN split_part(source, '://', 1) || ':' || t
  WHEN t <> '' AND NOT regexp_matches(t, '(?i)^(?:#|[a-z][a-z0-9+.\-]*:)') THEN scheme || host || CASE WHEN name = '' THEN own
  ELSE '/' || array_to_string(list_reduce([[]::VARCHAR[]] || list_transform(CASE WHEN s[-1] IN ('.', '..') THEN s || [''] ELSE s END,
  lambda x: [x]), lambda d, x: CASE x[1] WHEN '..' THEN d[1:len(d) - 1] WHEN '.' THEN d ELSE d || x END), '/') END || query
  END AS target FROM cut),
named AS (SELECT url, host, path, host || tail AS node FROM (SELECT url, {_url_parts('url')} FROM (
  SELECT url FROM pages UNION SELECT source FROM urls UNION SELECT target FROM urls WHERE target IS NOT NULL))),
ruled AS (SELECT *, CASE {_FITS} END AS fit FROM named),
edges AS (SELECT a.node AS x, b.node AS y FROM urls JOIN named AS a ON a.url = source JOIN named AS b ON b.url = target),
ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach AS (SELECT x AS node, y AS other FROM ways UNION
  SELECT node, y FROM reach JOIN ways ON other = x),
blocked AS (SELECT reach.node FROM reach JOIN ruled ON ruled.node = other WHERE fit IS NOT NULL GROUP BY reach.node
  HAVING bool_or(fit LIKE 'block %') AND NOT bool_or(fit LIKE 'allow %'))
SELECT page_id, host, path, nullif(split_part(coalesce(fit, ' '), ' ', 2), '') AS rule,
  CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 1)
  WHEN ruled.node IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM pages JOIN ruled ON pages.url IS NOT DISTINCT FROM ruled.url""",
    "op2_host_rules": f"""
WITH {MEASURED_SQL},
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM measured
  WHERE source IS NOT NULL GROUP BY source),
sums AS (SELECT (sum(f) + 0.5) / (sum(n) + 1) AS mean, coalesce(var_samp(f / n), 0) AS var, avg(1 / n) AS noise
  FROM hosts),
prior AS (SELECT mean, least(greatest(mean * (1 - mean)
  / greatest(var - mean * (1 - mean) * noise, mean * (1 - mean) / ({MAX_STRENGTH} + 1)) - 1, {MIN_STRENGTH}),
  {MAX_STRENGTH}) AS s FROM sums),
rates AS (SELECT source, n + s AS total, (f + mean * s) / (n + s) AS rate FROM hosts, prior),
verdicts AS (SELECT source, rate - {CAUTION} * sqrt(rate * (1 - rate) / (total + 1)) > {MAX_HOST_RATE} AS rejected
  FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected, false) AS kept, coalesce(rejected, false) AS host_rejected
FROM measured LEFT JOIN verdicts USING (source)""",
    "op5_decontamination": r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  AS t FROM documents UNION ALL SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT side, id, list_filter(string_split_regex(coalesce(t, ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM t),
windows AS (SELECT DISTINCT id AS item, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM (
  SELECT id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i
  FROM w WHERE side = 'b' AND len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM (
  SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, sizes WHERE side = 'd' AND len(ws) >= k)),
hits AS (SELECT id, item, i, p.k FROM places AS p JOIN windows USING (k, g)),
words AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY id),
items AS (SELECT id, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item::VARCHAR)), ',') AS all_items
  FROM hits GROUP BY id)
SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(all_items, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN words ON w.id = words.id LEFT JOIN items ON w.id = items.id WHERE side = 'd'""",
    "op11_vector_copies": """
WITH RECURSIVE usable AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable AS a JOIN usable AS b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a AS v, a AS r FROM links UNION SELECT links.b, r FROM reach JOIN links ON links.a = v),
least AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM embeddings LEFT JOIN least ON v = vec_id LEFT JOIN counted ON a = vec_id""",
    "op12_turn_repair": rf"""
WITH RECURSIVE crcs AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i::BIGINT] || range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i))),
drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':'
  || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM conversations, crcs),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
  CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE k <> 0),
placed AS (SELECT *, row_number() OVER c AS i, lag(left(role, 1)) OVER c AS before, left(role, 1) AS initial,
  regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged
  WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faulty AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN last IN ('.', '!', '?') THEN '' ELSE 't' END
  AS fault FROM placed),
counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
steps AS (SELECT conv_id, 0::BIGINT AS i, {_inserted("s0", "NULL", "NULL", "NULL")}
  FROM (SELECT DISTINCT conv_id, {{'c': 0, 'a': '', 'x': ''}} AS s0 FROM conversations)
  UNION ALL SELECT conv_id, i, {_inserted("q0", "q1", "q2", "q3")} FROM (
  SELECT steps.conv_id, faulty.i, {_ROW} FROM steps JOIN faulty
  ON steps.conv_id IS NOT DISTINCT FROM faulty.conv_id AND faulty.i = steps.i + 1)),
ends AS (SELECT conv_id, list_min(list_filter([p0, p3], lambda x: x IS NOT NULL)) AS best FROM steps
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
  sha256(substr(best.x, 2)) AS repaired_sha256
FROM ends LEFT JOIN counts ON ends.conv_id IS NOT DISTINCT FROM counts.conv_id""",
    "op13_hard_negatives": """
WITH usable AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
  list_dot_product(a.v, b.v)::BIGINT AS score FROM usable AS a JOIN usable AS b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT
  AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5""",
}

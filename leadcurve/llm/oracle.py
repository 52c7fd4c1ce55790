"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS words FROM documents
),
windows AS (
  SELECT rid, doc_id, i, array_to_string(words[i:i + 12], ' ') AS w
  FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - 11)) AS i
        FROM docs WHERE len(words) >= 13 AND doc_id IS NOT NULL)
),
least AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
gone AS (
  SELECT DISTINCT rid, i + k AS i
  FROM (SELECT rid, i, unnest(range(0, 13)) AS k
        FROM windows JOIN least USING (w) WHERE doc_id > least)
),
marked AS (
  SELECT d.rid, d.i, d.word, g.i IS NULL AS kept
  FROM (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs) d
  LEFT JOIN gone g ON g.rid = d.rid AND g.i = d.i
),
summed AS (
  SELECT rid, count(*) FILTER (NOT kept) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (kept) AS kept_text
  FROM marked GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM docs LEFT JOIN summed USING (rid)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents
),
sets AS (
  SELECT DISTINCT rid, doc_id, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT rid, doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i
        FROM docs WHERE len(words) > 0)
),
sizes AS (SELECT rid, doc_id, count(*) AS n FROM sets GROUP BY ALL),
common AS (
  SELECT a.rid AS ra, b.rid AS rb, count(*) AS c
  FROM sets a JOIN sets b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL
),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM common JOIN sizes x ON x.rid = ra JOIN sizes y ON y.rid = rb
  WHERE 100 * c >= 85 * (x.n + y.n - c)
),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT docs.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
       coalesce(docs.doc_id = component_id, true) AS kept
FROM docs LEFT JOIN sizes ON sizes.rid = docs.rid LEFT JOIN least ON least.doc_id = docs.doc_id
"""

QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         {WORDS} AS words FROM documents
),
windows AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) >= 8)
),
twice AS (SELECT rid, w FROM windows GROUP BY ALL HAVING count(*) > 1),
repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT rid, i, unnest(range(0, 8)) AS k FROM windows JOIN twice USING (rid, w)) GROUP BY rid
),
lines AS (
  SELECT rid, doc_id, host, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT rid, doc_id, host, unnest(string_split(text, chr(10))) AS line FROM docs)
),
shown AS (
  SELECT *, translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM lines WHERE len(words) > 0
),
same AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM shown GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM docs GROUP BY host),
common AS (
  SELECT host, norm, min(doc_id) AS first FROM shown JOIN hosts USING (host)
  GROUP BY host, norm, docs HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) * 100 > docs * 5
),
gone AS (
  SELECT rid, sum(len(words)) AS n FROM shown JOIN common USING (host, norm)
  WHERE doc_id IS DISTINCT FROM first GROUP BY rid
),
counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n, 0)::BIGINT AS n_common_words
  FROM docs LEFT JOIN same USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN gone USING (rid)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
            OR n_words - n_common_words < 20 OR 100 * (n_words - n_common_words) < 30 * n_words) AS kept
FROM counts
"""

# copies of a run are ordered by doc_id and place; rows that share a doc_id but not a text are not decided here
LINE_DEDUP = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT rid, doc_id, i, lines[i] AS line, array_to_string(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+'), ' ') AS norm
  FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs)
),
shown AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS pos FROM split WHERE norm <> ''),
runs AS (
  SELECT rid, doc_id, pos, norm || chr(10) || lead(norm) OVER w || chr(10) || lead(norm, 2) OVER w AS run
  FROM shown WHERE doc_id IS NOT NULL WINDOW w AS (PARTITION BY rid ORDER BY pos)
),
firsts AS (SELECT run, min((doc_id, pos)) AS first FROM runs WHERE run IS NOT NULL GROUP BY run),
later AS (SELECT rid, pos FROM runs JOIN firsts USING (run) WHERE (doc_id, pos) > first),
gone AS (SELECT DISTINCT rid, pos + k AS pos FROM (SELECT rid, pos, unnest([0, 1, 2]) AS k FROM later)),
starts AS (
  SELECT rid, pos, sum((pos > before + 3 OR before IS NULL)::INT) OVER (PARTITION BY rid ORDER BY pos) AS run
  FROM (SELECT rid, pos, lag(pos) OVER (PARTITION BY rid ORDER BY pos) AS before FROM later)
),
longest AS (SELECT rid, max(n) AS longest_run FROM (SELECT rid, run, max(pos) + 3 - min(pos) AS n FROM starts GROUP BY ALL) GROUP BY rid),
kept AS (
  SELECT s.rid, count(shown.pos) AS n_lines, count(gone.pos) AS n_removed,
         string_agg(s.line, chr(10) ORDER BY s.i) FILTER (gone.pos IS NULL) AS left_text
  FROM split s LEFT JOIN shown ON shown.rid = s.rid AND shown.i = s.i
  LEFT JOIN gone ON gone.rid = s.rid AND gone.pos = shown.pos GROUP BY s.rid
)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed,
       coalesce(longest_run, 0)::BIGINT AS longest_run, sha256(coalesce(left_text, '')) AS kept_sha256
FROM docs JOIN kept USING (rid) LEFT JOIN longest USING (rid)
"""



def _crc32(value: str) -> str:
    """The unsigned crc32 of a string of digits, bit by bit."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(range(8), lambda c, i: {bit}, xor(crc, b))"
    digits = f"list_transform(string_split({value}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce({digits}, lambda crc, b: {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, nodes: str) -> str:
    """All nodes above ``nodes`` (own, place, count, digest), and the siblings of each."""
    run = "PARTITION BY level, own, place // 3 ORDER BY place ROWS BETWEEN"
    return rf"""
{name}_tree AS (
  SELECT 0 AS level, own, place, count, digest FROM {nodes}
  UNION ALL
  SELECT level + 1, own, place // 3, (count + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM {name}_tree WHERE count > 1 GROUP BY level, own, place // 3, count
),
{name}_sides AS (
  SELECT level, own, place, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}_tree WHERE count > 1
)"""


def _climb(name: str, start: str, tree: str) -> str:
    """The rows of ``start`` (rid, own, place, digest, proof) at each level on their way up."""
    return rf"""
{name} AS (
  SELECT rid, 0 AS level, own, place, digest, proof FROM {start}
  UNION ALL
  SELECT rid, c.level + 1, c.own, c.place // 3, sha256(l || digest || r), proof || l || r
  FROM {name} c JOIN {tree}_sides s ON s.level = c.level AND s.own = c.own AND s.place = c.place
)"""


MERKLE = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {_leaf("text")} AS leaf,
         {_leaf("replace(text, chr(10), '')")} AS tampered, {_crc32("doc_id::VARCHAR")} AS crc FROM documents
),
leaves AS (
  SELECT rid, coalesce('s' || source, '') AS own, leaf AS digest,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS count FROM docs
),
{_tree("lower", "leaves")},
subroots AS (
  SELECT '' AS own, own AS source, digest, row_number() OVER (ORDER BY encode(own)) - 1 AS place, count(*) OVER () AS count
  FROM lower_tree WHERE count = 1
),
{_tree("upper", "subroots")},
low_start AS (
  SELECT rid, own, place, CASE WHEN crc % 2 = 0 THEN tampered ELSE leaf END AS digest, '' AS proof FROM leaves JOIN docs USING (rid)
),
{_climb("low_way", "low_start", "lower")},
top_start AS (
  SELECT rid, s.own, s.place, w.digest, proof FROM low_way w
  JOIN (SELECT rid, max(level) AS level FROM low_way GROUP BY rid) USING (rid, level) JOIN subroots s ON s.source = w.own
),
{_climb("top_way", "top_start", "upper")},
ends AS (
  SELECT rid, digest, proof FROM top_way JOIN (SELECT rid, max(level) AS level FROM top_way GROUP BY rid) USING (rid, level)
)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, e.digest AS folded_root,
       e.digest = t.digest AS verified
FROM docs JOIN ends e USING (rid) JOIN leaves l USING (rid) JOIN subroots s ON s.source = l.own
JOIN upper_tree t ON t.count = 1
"""

# every period is tried: words that are q apart and identical, in stretches without a gap
PERIODIC = rf"""
WITH raw AS (
  SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS words, {_crc32("doc_id::VARCHAR")} AS h FROM documents
),
drawn AS (SELECT *, len(words) AS n, h // 10 AS g, h % 10 = 0 AND len(words) > 0 AS changed FROM raw),
placed AS (SELECT *, CASE WHEN changed THEN g % n END AS a FROM drawn),
docs AS (
  SELECT rid, doc_id, n, CASE WHEN changed
    THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
    ELSE words END AS words
  FROM placed
),
shown AS (SELECT rid, n, i, words[i + 1] AS word FROM (SELECT rid, n, words, unnest(range(n)) AS i FROM docs)),
pairs AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM shown x JOIN shown y ON x.rid = y.rid AND x.word = y.word
   AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
),
stretches AS (
  SELECT rid, q, min(i) AS s, count(*) + q AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs) GROUP BY rid, q, island
),
runs AS (SELECT rid, s, n, min(q) AS q FROM stretches WHERE n >= greatest(6, 4 * q) GROUP BY rid, s, n),
summed AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
         first((s, n, q) ORDER BY n DESC, s, q) AS longest FROM runs GROUP BY rid
),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS left_text FROM shown ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, longest[1]::BIGINT AS start, longest[2]::BIGINT AS length,
       longest[3]::BIGINT AS period, (1000 * longest[2] // longest[3])::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(left_text, '')) AS collapsed_sha256
FROM docs LEFT JOIN summed USING (rid) LEFT JOIN kept USING (rid)
"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op3_quality_rules": QUALITY,
    "op5_line_dedup": LINE_DEDUP,
    "op8_minhash": MINHASH,
    "op12_merkle": MERKLE,
    "op13_periodic_runs": PERIODIC,
}

"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from gatesift.llm.mixing import SEED as MIX_SEED
from gatesift.llm.quality_rules import STOP_WORDS, SYMBOLS, THRESHOLDS
from gatesift.llm.url_filter import RULES

_WORD = r"[^\x20\x09-\x0D]+"

NGRAM_JOIN = f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s
  FROM words),
grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (
  SELECT x, y FROM shared WHERE 100 * k >= 80 * (nx + ny - k)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets
  UNION
  SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id,
       CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON s.doc_id = m.x
LEFT JOIN (SELECT x, count(*) AS n FROM edges GROUP BY x) l ON s.doc_id = l.x
"""

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([1, 2, 3][rank % 3 + 1] AS BIGINT) AS weight FROM sources),
levels AS (
  SELECT *, source_size / weight AS fill,
         row_number() OVER (ORDER BY source_size / weight, rank) AS place,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
           ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS DOUBLE) AS left_size,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (
           ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS DOUBLE) AS left_weight FROM weighed),
first_open AS (
  SELECT place, left_size, left_weight FROM levels
  WHERE NOT (left_size / left_weight * weight > 3 * source_size) ORDER BY place LIMIT 1),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN l.place < f.place THEN CAST(3 * l.source_size AS DOUBLE)
              ELSE f.left_size / f.left_weight * l.weight END AS target
  FROM levels l, first_open f),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS quota,
         CAST(coalesce(sum(d.size) OVER (
           PARTITION BY d.source
           ORDER BY substr(md5('{MIX_SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 16), d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (quota // greatest(source_size, 1))
            + greatest(0, least(size, quota % greatest(source_size, 1) - start)) AS BIGINT) AS taken
FROM placed
"""


def _rule(metric: str, least, greatest) -> str:
    tests = [f"{metric} >= {least}::DOUBLE"] * (least is not None)
    tests += [f"{metric} <= {greatest}::DOUBLE"] * (greatest is not None)
    return " AND ".join(tests)


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
QUALITY_RULES = f"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '{_WORD}') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM texts),
windows AS (
  SELECT row_id, i, array_to_string(w[i:i + 4], ' ') AS grams
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, grams) AS n FROM windows)
  WHERE n > 1),
repeated AS (
  SELECT row_id, count(DISTINCT p) AS n FROM (
    SELECT row_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM twice) GROUP BY row_id),
counted AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
         length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper
  FROM split s LEFT JOIN repeated r USING (row_id)),
ratios AS (
  SELECT *, word_chars / greatest(n_words, 1) AS word_length,
         n_symbols / greatest(word_chars, 1) AS symbol_ratio,
         n_stop / greatest(n_words, 1) AS stop_word_ratio,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
         n_upper / greatest(word_chars, 1) AS upper_ratio,
         n_words / greatest(n_lines, 1) AS line_words,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(_rule(*t) for t in THRESHOLDS)} AS kept
FROM ratios
"""

_RULES = ", ".join(f"('{v}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)
URL_FILTER = f"""
WITH rules AS (SELECT * FROM (VALUES {_RULES}) AS t(verdict, host, path)),
parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS row_id FROM pages),
fits AS (
  SELECT p.row_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parsed p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.row_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f USING (row_id)
"""

_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(string_split({}, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                           lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _step(state: str, letter: str, cost: str, when: str = "true") -> str:
    return (f"CASE WHEN {state} IS NOT NULL AND ({when}) "
            f"THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}} END")


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


_INTO_USER = [_step(s, "K", "t", "NOT gone AND role = 'u'") for s in ("q0", "q1", "q3")] + \
             [_step(s, "R", "2 + t", "NOT gone AND role <> 'u'") for s in ("q0", "q1", "q3")]
_INTO_ASSISTANT = [_step("q2", "K", "t", "NOT gone AND role = 'a'"),
                   _step("q2", "R", "2 + t", "NOT gone AND role <> 'a'")]
_INSERTED = _least("p2", _step("p0", "I", "2"), _step("p1", "I", "2"), _step("p3", "I", "2"))

# The lattice turn by turn: the least (cost, audit) that leads to each of the four states.
CONVERSATION_REPAIR = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20
           AS fate FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM given) WHERE fate <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS said,
         rtrim(text, {_BLANKS}) AS solid
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i
        FROM damaged)),
turns AS MATERIALIZED (
  SELECT conv_id, turn, role AS whole_role, substr(role, 1, 1) AS role, text, i, solid = '' AS blank,
         solid <> '' AND said > 1 AS duplicate,
         solid <> '' AND said = 1 AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated,
         solid = '' OR said > 1 AS gone,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1)
           NOT IN ('su', 'ua', 'au') AS illegal FROM ordered),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': ''}} AS p0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS p1,
         CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS p2, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS p3
  FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, i, {_step("q0", "D", "3")},
         {_least(_step("q1", "D", "3"), _step("q0", "K", "t", "NOT gone AND role = 's'"))},
         {_least(_step("q2", "D", "3"), *_INTO_USER)},
         {_least(_step("q3", "D", "3"), *_INTO_ASSISTANT)}
  FROM (
    SELECT *, {_least("p3", _step("q2", "I", "2"))} AS q3 FROM (
      SELECT w.conv_id, t.i, p0 AS q0, p1 AS q1, p3, {_INSERTED} AS q2, role, gone, CAST(truncated AS INTEGER) AS t
      FROM walk w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1))),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(i) AS n
  FROM turns GROUP BY conv_id),
solved AS MATERIALIZED (
  SELECT c.*, {_least("p0", "p3", _step("q2", "I", "2"))} AS best
  FROM counted c JOIN (SELECT *, {_INSERTED} AS q2 FROM walk) w
    ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i),
letters AS (
  SELECT conv_id, k, substr(best.a, k, 1) AS letter,
         length(replace(substr(best.a, 1, k), 'I', '')) AS i,
         length(replace(substr(best.a, 1, k), 'D', '')) - 1 AS place
  FROM (SELECT conv_id, best, unnest(range(1, length(best.a) + 1)) AS k FROM solved)),
kept AS (
  SELECT l.conv_id, k, letter, place, t.whole_role, t.text,
         max(CASE WHEN place = 0 AND letter = 'K' AND t.role = 's' THEN 1 ELSE 0 END)
           OVER (PARTITION BY l.conv_id) AS system
  FROM letters l LEFT JOIN turns t ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.i = t.i AND letter <> 'I'
  WHERE letter <> 'D'),
mended AS (
  SELECT conv_id, sha256(string_agg(
    CASE WHEN letter = 'K' THEN whole_role WHEN (place - system) % 2 = 0 THEN 'user' ELSE 'assistant' END
      || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS repaired_sha256 FROM kept GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(s.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(s.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(s.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(s.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s.best.c, 0) AS BIGINT) AS cost,
       coalesce(s.best.a, '') AS audit, coalesce(m.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN solved s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN mended m ON o.conv_id IS NOT DISTINCT FROM m.conv_id
"""

# A node's name is the list of its turns; a conversation is under each of its prefixes.
PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS said,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
given AS (SELECT conv_id, list(said ORDER BY i) AS turns FROM turns GROUP BY conv_id),
cut AS (
  SELECT *, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 6 AS h, conv_id - conv_id % 100 AS family FROM given),
rebuilt AS MATERIALIZED (
  SELECT c.conv_id, list_concat(CASE WHEN h > 0 THEN coalesce(g.turns, [])[1:h] ELSE [] END, c.turns[h + 1:]) AS turns
  FROM cut c LEFT JOIN given g ON c.family = g.conv_id),
members AS (
  SELECT conv_id, turns, d, turns[1:d] AS prefix
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = d), '') AS ends,
         CASE WHEN d > 0 THEN (count(*) - 1) * length(prefix[d].t) ELSE 0 END AS saved
  FROM members GROUP BY prefix, d),
named AS MATERIALIZED (
  SELECT n.*, p.conv_id AS parent_conv_id, p.prefix AS parent
  FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1]),
children AS (SELECT parent, count(*) AS k FROM named WHERE d > 0 GROUP BY parent),
counted AS MATERIALIZED (
  SELECT n.*, coalesce(k, 0) AS k FROM named n LEFT JOIN children c ON n.prefix = c.parent),
above AS (
  SELECT prefix[1:e] AS top, e, saved, k = 0 AS leaf
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM counted)),
subtrees AS (SELECT top, e, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM above GROUP BY top, e)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(d AS BIGINT) AS depth, CAST(parent_conv_id AS BIGINT) AS parent_conv_id,
       CAST(n AS BIGINT) AS n_convs, CAST(k AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM counted c JOIN subtrees s ON c.prefix = s.top AND c.d = s.e
"""

SQL = {
    "op1_ngram_join": NGRAM_JOIN,
    "op2_mixing": MIXING,
    "op5_quality_rules": QUALITY_RULES,
    "op10_url_filter": URL_FILTER,
    "op11_prefix_trie": PREFIX_TRIE,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}

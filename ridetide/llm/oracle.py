"""SQL counterparts, written for DuckDB over the same tables, of the queries that SQL can express.

They compare everything with everything, which is what the operators avoid. SQL expresses neither
tokenizing, clustering, learned models nor a choice of splitters or of documents for a budget.
"""

from __future__ import annotations

import string

_BLANK = r"[\x09-\x0D\x20]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{_BLANK}'), lambda w: w <> '')"


def _components(nodes: str, edges: str) -> str:
    """(id, component_id): the least id that the edges (a, b) lead to, both ways."""
    return f"""SELECT id, min(other) AS component_id FROM (
  WITH RECURSIVE reach(id, other) AS (
    SELECT id, id FROM {nodes}
    UNION SELECT reach.id, both_ways.b FROM reach
      JOIN (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}) both_ways ON both_ways.a = reach.other)
  SELECT id, other FROM reach) GROUP BY id"""


_REPEATS = f"""WITH w AS (SELECT doc_id, {_words("text")} AS words FROM documents),
windows AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS key
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50)),
firsts AS (SELECT key, min(doc_id) AS first FROM windows GROUP BY key),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS pos FROM windows JOIN firsts USING (key) WHERE doc_id > first),
places AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM places ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST((SELECT count(*) FROM gone WHERE gone.doc_id = w.doc_id) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_NEAR = f"""WITH w AS (SELECT doc_id, {_words(_LOWER)} AS words FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 1 THEN words
  ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingles FROM w),
parts AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
edges AS (SELECT x.doc_id AS a, y.doc_id AS b FROM parts x JOIN parts y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
nodes AS (SELECT doc_id AS id FROM documents)
SELECT sets.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN ({_components("nodes", "edges")}) c ON c.id = sets.doc_id"""

_USABLE = """embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""


def _dot(a: str, b: str) -> str:
    """Added up in the order of the components."""
    return f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]), lambda x, y: x + y)"


_VECTORS = f"""SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {_USABLE}"""
_LINKS = f"""WITH vecs AS ({_VECTORS}),
edges AS (SELECT x.id AS a, y.id AS b FROM vecs x JOIN vecs y ON x.label = y.label AND x.id < y.id AND len(x.v) = len(y.v)
  WHERE {_dot("x.v", "y.v")} / (sqrt({_dot("x.v", "x.v")}) * sqrt({_dot("y.v", "y.v")})) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings),
ends AS (SELECT a AS id FROM edges UNION ALL SELECT b FROM edges)
SELECT nodes.id AS vec_id, CAST((SELECT count(*) FROM ends WHERE ends.id = nodes.id) AS BIGINT) AS n_links, component_id,
  nodes.id = component_id AS kept
FROM nodes JOIN ({_components("nodes", "edges")}) c ON c.id = nodes.id"""

_NEAREST = f"""WITH vecs AS ({_VECTORS}),
scored AS (SELECT q.id AS query_id, v.id AS vec_id, {_dot("v.v", "q.v")} AS score
  FROM vecs q JOIN vecs v ON q.id <> v.id WHERE q.id % 20 = 0)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored) WHERE n <= 20"""

_LINE_KEY = f"""translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  '{string.ascii_uppercase}', '{string.ascii_lowercase}')"""
_LINES = f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
keys AS (SELECT *, {_LINE_KEY} AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS last FROM keys WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keys.*, repeated.last IS NOT NULL AND doc_id < repeated.last AS gone FROM keys LEFT JOIN repeated USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

# crc32, a byte at a time: its table of 256 entries comes from its polynomial, 0xEDB88320.
_CRC_TABLE = """SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n], range(0, 8)),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps"""


def _crc32(text: str) -> str:
    """Of the UTF-8 bytes; ``steps`` is the table."""
    codes = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2] AS BIGINT))"
    return f"""xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}),
  lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"""


# levenshtein counts bytes here: letters beyond ASCII are written as characters that no word holds.
_SINGLE_BYTES = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c not in "'{}")[:64]
_LATIN = "".join(map(chr, range(0xC0, 0x100)))
_VARIANTS = f"""WITH RECURSIVE crc AS ({_CRC_TABLE}),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
marked AS (SELECT run, n, {_crc32("(doc_id || ':' || run)")} AS h FROM counted, crc),
words AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM marked),
vocabulary AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, '{_LATIN}', '{_SINGLE_BYTES}') AS plain
  FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM vocabulary a JOIN vocabulary b
  ON length(b.plain) BETWEEN length(a.plain) - 1 AND length(a.plain) + 1 AND a.plain <> b.plain AND levenshtein(a.plain, b.plain) = 1),
best AS (SELECT word, CAST(count(*) AS BIGINT) AS n_near, arg_min(struct_pack(other := other, other_n := other_n), (-other_n, encode(other))) AS top
  FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.other_n >= 10 * v.n THEN top.other END AS form,
  CASE WHEN top.other_n >= 10 * v.n THEN top.other_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
path(word, root) AS (SELECT word, word FROM formed
  UNION ALL SELECT path.word, formed.form FROM path JOIN formed ON formed.word = path.root WHERE formed.form IS NOT NULL)
SELECT f.word, f.form, path.root, f.n, f.n_near, f.form_n FROM formed f JOIN path USING (word)
WHERE path.root IN (SELECT word FROM formed WHERE form IS NULL)"""

# Insertions before a row lead from ``before`` to ``here``; ``put`` is what they add to the repaired text.
_INSERTIONS = """(VALUES (0, 0, 0, ''), (0, 1, 2, '|user:'), (0, 2, 3, '|user:|assistant:'), (1, 0, 1, ''), (1, 1, 2, '|user:'),
  (1, 2, 3, '|user:|assistant:'), (2, 0, 2, ''), (2, 1, 3, '|assistant:'), (2, 2, 2, '|assistant:|user:'), (3, 0, 3, ''),
  (3, 1, 2, '|user:'), (3, 2, 3, '|user:|assistant:')) AS t(before, inserted, here, put)"""
_BARE = "trim({0}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_REPAIRS = f"""WITH RECURSIVE crc AS ({_CRC_TABLE}),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS c FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
  CASE c WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN c = 3 THEN [1, 2] ELSE [1] END) AS copy FROM given WHERE c <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  {_BARE.format("text")} AS bare FROM damaged),
faulty AS (SELECT conv_id, turn, role, text, i, role[1] AS initial, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate'
  WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS initial_before FROM numbered),
facts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
  count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) AS length,
  count(*) FILTER (WHERE initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
ways AS (SELECT before, here, put, repeat('I', inserted) || edit AS word, edit,
  3 * inserted + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END AS cost
  FROM {_INSERTIONS}, (VALUES ('D'), ('R'), ('K')) AS e(edit)),
moves AS (SELECT f.conv_id, f.i, w.before, w.word, w.cost + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 3 ELSE 0 END AS cost,
  CASE WHEN edit = 'D' THEN here WHEN edit = 'R' THEN CASE here WHEN 2 THEN 3 ELSE 2 END WHEN initial = 's' THEN 1 WHEN initial = 'u' THEN 2 ELSE 3 END AS after,
  replace(put, '|', chr(10)) || CASE edit WHEN 'K' THEN chr(10) || role || ':' || text
    WHEN 'R' THEN chr(10) || CASE here WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || text ELSE '' END AS put
  FROM faulty f, ways w WHERE edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (edit = 'R'
    OR (initial = 's' AND here = 0) OR (initial = 'u' AND here <> 2) OR (initial = 'a' AND here = 2)))),
path AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS out FROM facts
  UNION ALL SELECT p.conv_id, p.i + 1, m.after, CAST(min(p.cost + m.cost) AS BIGINT), arg_min(p.audit || m.word, (p.cost + m.cost, p.audit || m.word)),
    arg_min(p.out || m.put, (p.cost + m.cost, p.audit || m.word))
  FROM path p JOIN moves m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1 AND m.before = p.state GROUP BY 1, 2, 3),
ended AS (SELECT p.conv_id, p.cost + e.cost AS cost, audit || word AS audit, out || replace(put, '|', chr(10)) AS out
  FROM path p JOIN facts ON facts.conv_id IS NOT DISTINCT FROM p.conv_id AND facts.length = p.i
  JOIN (VALUES (0, 0, '', ''), (1, 6, 'II', '|user:|assistant:'), (2, 3, 'I', '|assistant:'), (3, 0, '', '')) AS e(state, cost, word, put) USING (state)),
best AS (SELECT conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(out, (cost, audit)) AS out FROM ended GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(out[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id"""

ORACLE: dict[str, str] = {
    "op2_minhash_near_dedup": _NEAR,
    "op3_embedding_near_dedup": _LINKS,
    "op8_substring_dedup": _REPEATS,
    "op10_onebit_ann": _NEAREST,
    "op11_conversation_repair": _REPAIRS,
    "op12_spelling_variants": _VARIANTS,
    "op13_line_dedup": _LINES,
}

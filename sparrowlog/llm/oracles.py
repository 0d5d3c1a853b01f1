"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 as text: a table by rule, and a fold over the UTF-8 bytes of a text of code points below 2048.
TABLE = "tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))"


def crc(text: str) -> str:
    points = f"list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT)"
    utf8 = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 | (p >> 6), 128 | (p & 63)] END))"
    return f"xor(list_reduce([4294967295] || {utf8}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


SPELLING = f"""
WITH RECURSIVE {TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS k, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {crc("k")} AS h FROM counted, tab),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS form, max(n) AS form_n FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS following FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.following)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.following IS NULL"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE split AS (SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM split),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * pairs.n >= 85 * (x.n + y.n - pairs.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT id, id AS other FROM split UNION SELECT r.id, l.b FROM reached r JOIN both_ways l ON l.a = r.other),
least AS (SELECT r.id, min(s.doc_id) AS component_id FROM reached r JOIN split s ON s.id = r.other GROUP BY r.id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM split JOIN least USING (id) LEFT JOIN sizes USING (id)"""

CONVERSATION_TRIE = rf"""
WITH {TABLE},
own AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x, {{'h': sha256(length(r)::VARCHAR || ':' || r || x), 'w': len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))}} AS t
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, r, x) AS ts FROM own GROUP BY conv_id),
hashed AS (SELECT conv_id, ts, ({crc("conv_id::VARCHAR")} % 4)::BIGINT AS h FROM convs, tab),
rebuilt AS (SELECT c.conv_id, coalesce(b.ts[1:h], []) || c.ts[h + 1:] AS s FROM hashed c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
places AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM rebuilt),
nodes AS (
  SELECT s[1:d] AS p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends
  FROM places GROUP BY 1, 2),
children AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * p[depth].w ELSE 0 END AS saved FROM nodes LEFT JOIN children USING (p)),
above AS (SELECT p, n_children, saved, unnest(range(depth + 1)) AS d FROM full_nodes),
subtrees AS (SELECT p[1:d] AS p, (count(*) FILTER (n_children = 0))::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN subtrees USING (p) LEFT JOIN nodes u ON n.depth > 0 AND u.p = n.p[1:n.depth - 1]"""

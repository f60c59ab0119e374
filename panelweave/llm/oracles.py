"""SQL twins of the queries that SQL can express; the others are tested against plain versions in tests/llm."""

_WORD = r"[^\x20\x09-\x0D]+"

OP4 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)"""

OP9 = rf"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
c AS (SELECT t FROM g GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM g JOIN c USING (t)),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP10 = r"""WITH l AS MATERIALIZED (
  SELECT doc_id, i - 1 AS n, x, trim(x, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
f AS MATERIALIZED (SELECT line, length(line) AS size, min(doc_id * 10000000 + n) AS place FROM l WHERE length(line) >= 32 GROUP BY 1),
pairs AS (
  SELECT a.line AS a, b.line AS b, a.place AS pa, b.place AS pb FROM f a JOIN f b ON a.size = b.size AND left(a.line, a.size // 2) = left(b.line, b.size // 2) WHERE a.line < b.line
  UNION SELECT a.line, b.line, a.place, b.place FROM f a JOIN f b ON a.size = b.size AND substr(a.line, a.size // 2 + 1) = substr(b.line, b.size // 2 + 1) WHERE a.line < b.line
  UNION SELECT a.line, b.line, a.place, b.place FROM f a JOIN f b ON a.size = b.size - 1 AND left(a.line, a.size // 2) = left(b.line, (b.size - 1) // 2)
  UNION SELECT a.line, b.line, a.place, b.place FROM f a JOIN f b ON a.size = b.size - 1 AND substr(a.line, a.size // 2 + 1) = substr(b.line, (b.size - 1) // 2 + 2)),
near AS MATERIALIZED (SELECT * FROM pairs WHERE list_bool_or(list_transform(range(0, length(a) + 1), lambda k:
  left(a, k) = left(b, k) AND CASE WHEN length(a) = length(b) THEN substr(a, k + 2) = substr(b, k + 2) ELSE substr(a, k + 1) = substr(b, k + 2) END))),
early AS (SELECT line, min(place) AS place FROM (SELECT line, place FROM f UNION ALL SELECT a, pb FROM near UNION ALL SELECT b, pa FROM near) GROUP BY 1),
marked AS (SELECT l.*, coalesce(place < doc_id * 10000000 + n, false) AS gone FROM l LEFT JOIN early USING (line))
SELECT doc_id, count(n) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  CASE WHEN count(n) > 0 THEN sha256(coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) END AS kept_sha256
FROM documents LEFT JOIN marked USING (doc_id) GROUP BY 1"""

_MARKS = r"^((?:[ \t]*>)+)[ \t]?"

OP6 = rf"""WITH RECURSIVE rows AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, turn - CASE WHEN turn % 5 = 4 THEN 2 ELSE 1 END AS near FROM conversations),
mail AS MATERIALIZED (
  SELECT r.conv_id, r.turn, r.role, concat(CASE WHEN f.text IS NOT NULL THEN concat('> > ', replace(f.text, chr(10), concat(chr(10), '> > ')), chr(10)) END,
    CASE WHEN n.text IS NOT NULL THEN concat('> ', replace(n.text, chr(10), concat(chr(10), '> ')), chr(10)) END, r.text) AS text
  FROM rows r LEFT JOIN rows n ON n.conv_id = r.conv_id AND n.turn = r.near LEFT JOIN rows f ON f.conv_id = r.conv_id AND f.turn = r.near - 1),
lines AS MATERIALIZED (
  SELECT conv_id, turn, i, x, length(regexp_replace(regexp_extract(x, '{_MARKS}', 1), '[^>]', '', 'g')) AS level, lower(trim(regexp_replace(regexp_replace(x, '{_MARKS}', ''), '\s+', ' ', 'g'))) AS said
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM mail)),
stepped AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i) THEN 1 ELSE 0 END AS new FROM lines WHERE said <> ''),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM stepped),
passages AS MATERIALIZED (SELECT conv_id, turn, n, level, string_agg(said, chr(10) ORDER BY i) AS whole, list(said) AS each FROM numbered GROUP BY ALL),
names AS MATERIALIZED (SELECT conv_id, turn, n, level, 1 AS kind, whole AS name FROM passages UNION SELECT conv_id, turn, n, level, 0, unnest(each) FROM passages),
found AS (SELECT q.conv_id, q.turn, q.n, q.level, arg_max(o.turn, q.kind * 1000000000 + o.turn) AS source
  FROM names q JOIN names o ON o.conv_id = q.conv_id AND o.kind = q.kind AND o.name = q.name AND o.level = 0 AND o.turn < q.turn WHERE q.level > 0 GROUP BY ALL),
linked AS MATERIALIZED (SELECT m.conv_id, m.turn, (SELECT count(*) FROM passages p WHERE p.conv_id = m.conv_id AND p.turn = m.turn AND p.level > 0) AS n_quotes,
    count(f.source) AS n_linked, arg_max(f.source, f.source - f.level * 1000000000) AS parent FROM mail m LEFT JOIN found f ON f.conv_id = m.conv_id AND f.turn = m.turn GROUP BY 1, 2),
up AS (SELECT conv_id, turn, turn AS root, parent AS next, 0 AS depth FROM linked
  UNION ALL SELECT u.conv_id, u.turn, l.turn, l.parent, u.depth + 1 FROM up u JOIN linked l ON l.conv_id = u.conv_id AND l.turn = u.next),
tops AS (SELECT conv_id, turn, root, depth FROM up WHERE next IS NULL),
contents AS (SELECT conv_id, turn, trim(string_agg(x, chr(10) ORDER BY i), concat(' ', chr(9), chr(10), chr(13))) AS content FROM lines WHERE level = 0 GROUP BY 1, 2)
SELECT m.conv_id, m.turn, m.role, coalesce(content, '') AS content, parent AS parent_turn, root AS root_turn, depth AS reply_depth,
  row_number() OVER (PARTITION BY m.conv_id ORDER BY root, m.turn) - 1 AS position, n_quotes, n_linked, CAST(to_json({{'role': m.role, 'content': coalesce(content, '')}}) AS VARCHAR) AS message
FROM mail m JOIN linked USING (conv_id, turn) JOIN tops USING (conv_id, turn) LEFT JOIN contents USING (conv_id, turn)"""

OP12 = """WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

OP13 = """WITH t AS MATERIALIZED (
  SELECT conv_id, text, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS place FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest
    FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, x: list_reduce([xor(a, x), 1, 2, 3, 4, 5, 6, 7, 8], lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, place, text, digest FROM c JOIN t ON t.conv_id = c.base AND place <= h
  UNION ALL SELECT conv_id, 1, place, text, digest FROM c JOIN t USING (conv_id) WHERE place > h),
p AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, string_agg(digest, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS MATERIALIZED (SELECT path, max(depth) AS depth, min(conv_id) AS least, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY 1),
k AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY 1) GROUP BY 1),
below AS (SELECT p.path, sum((v.n_convs - 1) * v.chars) AS saved, count(*) FILTER (k.path IS NULL) AS leaves
  FROM n v LEFT JOIN k ON k.path = v.path JOIN p ON p.conv_id = v.least AND p.depth <= v.depth GROUP BY 1)
SELECT n.least AS conv_id, n.depth, up.least AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, below.leaves AS n_leaves,
  below.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN below USING (path) LEFT JOIN k USING (path) LEFT JOIN e USING (path)
LEFT JOIN n up ON n.depth > 0 AND up.path = left(n.path, length(n.path) - 64)"""

ORACLE = {
    "op4_jaccard_join": OP4,
    "op6_quotations": OP6,
    "op9_substring_dedup": OP9,
    "op10_line_dedup": OP10,
    "op12_near_vectors": OP12,
    "op13_prefix_trie": OP13,
}

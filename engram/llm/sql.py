"""SQL for the training-data queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id"""

OP3 = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
wi AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM t WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM wi GROUP BY s),
hit AS (SELECT wi.doc_id, p FROM wi JOIN f ON f.s = wi.s WHERE m < wi.doc_id),
st AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM st),
sp AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, k),
seg AS (SELECT doc_id, a AS place, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM sp UNION ALL SELECT t.doc_id, n, max(b), n FROM sp JOIN t ON t.doc_id = sp.doc_id GROUP BY t.doc_id, n),
kept AS (SELECT t.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY place) AS k FROM seg JOIN t ON t.doc_id = seg.doc_id GROUP BY t.doc_id),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM sp GROUP BY doc_id)
SELECT t.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.k, h))) AS kept_sha256
FROM t LEFT JOIN c ON c.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id"""

_WORDS = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP5 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
k AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), 'null') AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""

ORACLE = {"op2_jaccard_join": OP2, "op3_suffix_dedup": OP3, "op5_decontaminate": OP5}

_SPLIT = "string_split(coalesce({0}, ''), chr(10))"
_MARKS = "'^(?:[ \\t]*>)+'"
_NORMAL = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_STRIP = "regexp_replace(regexp_replace({0}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
OP4 = f"""WITH RECURSIVE m AS (SELECT conv_id, turn, min({{'r': role, 't': text}}) AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
l AS (SELECT conv_id, turn, unnest({_SPLIT.format('x.t')}) AS line, generate_subscripts({_SPLIT.format('x.t')}, 1) AS n, len({_SPLIT.format('x.t')}) AS size FROM m),
p AS (SELECT conv_id, turn, n, size, length(regexp_replace(regexp_extract(line, {_MARKS}, 0), '[^>]', '', 'g')) AS d, regexp_replace(line, {_MARKS}, '') AS t FROM l),
own AS (SELECT conv_id, turn, {_STRIP.format("coalesce(string_agg(t, chr(10) ORDER BY n) FILTER (WHERE d = 0), '')")} AS content, count(*) FILTER (WHERE d > 0) AS nq FROM p GROUP BY conv_id, turn),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY n) AS k FROM (SELECT *, CASE WHEN d = lag(d) OVER (PARTITION BY conv_id, turn ORDER BY n) THEN 0 ELSE 1 END AS fresh FROM p)),
pas AS (SELECT conv_id, turn, d, 'passage' AS kind, string_agg(t, chr(10) ORDER BY n) AS t FROM run WHERE size > 1 GROUP BY conv_id, turn, d, k),
nb AS (SELECT conv_id, turn, d, kind, {_NORMAL.format('t')} AS t FROM (SELECT conv_id, turn, d, 'line' AS kind, t FROM p UNION ALL SELECT * FROM pas)),
wanted AS (SELECT DISTINCT conv_id, turn, d, t FROM nb WHERE d > 0 AND t <> '' AND (kind = 'passage' OR length(t) >= 12)),
origin AS (SELECT conv_id, t, min(turn) AS o FROM (SELECT conv_id, turn, t FROM nb WHERE d = 0 UNION ALL SELECT conv_id, turn, {_NORMAL.format('content')} FROM own) WHERE t <> '' GROUP BY conv_id, t),
v AS (SELECT w.conv_id, w.turn, o, min(d) AS d, sum(length(w.t)) AS c FROM wanted w JOIN origin g ON g.conv_id = w.conv_id AND g.t = w.t WHERE o < w.turn GROUP BY w.conv_id, w.turn, o),
best AS (SELECT conv_id, turn, arg_min(o, {{'a': d, 'b': -c, 'c': o}}) AS parent FROM v GROUP BY conv_id, turn),
r AS (SELECT conv_id, turn, parent AS root FROM best UNION ALL SELECT r.conv_id, r.turn, b.parent FROM r JOIN best b ON b.conv_id = r.conv_id AND b.turn = r.root),
roots AS (SELECT conv_id, turn, min(root) AS root FROM r GROUP BY conv_id, turn),
out AS (SELECT m.conv_id, m.turn, m.x.r AS role, own.content, own.nq AS n_quotes, best.parent AS parent_turn, coalesce(roots.root, m.turn) AS thread_turn FROM m JOIN own ON own.conv_id = m.conv_id AND own.turn = m.turn
 LEFT JOIN best ON best.conv_id = m.conv_id AND best.turn = m.turn LEFT JOIN roots ON roots.conv_id = m.conv_id AND roots.turn = m.turn)
SELECT *, concat('<|', coalesce(role, 'unknown'), '|>', chr(10), content, chr(10), '<|end|>') AS chat FROM out"""

ORACLE["op4_chat"] = OP4

_X = ", ".join(f"v[4 * p + {k}] AS x{k}" for k in range(1, 5))
_D = " + ".join(f"(x{k} - c{k}) * (x{k} - c{k})" for k in range(1, 5))
_CHOSEN = "SELECT r, p, min({{'d': d, 'k': k}}) AS m FROM (SELECT r, pt.p, k, " + _D + " AS d FROM pt JOIN {0} c ON c.p = pt.p) GROUP BY r, p"
_MEANS = ", ".join(f"CASE WHEN n IS NULL THEN c{k} ELSE (s{k} - ((s{k} % n) + n) % n) // n END AS c{k}" for k in range(1, 5))
_SUMS = ", ".join(f"sum(x{k})::BIGINT AS s{k}" for k in range(1, 5))
_NEXT = "SELECT c.p, c.k, " + _MEANS + " FROM {0} c LEFT JOIN (SELECT pt.p, m.k AS k, count(*) AS n, " + _SUMS + " FROM {1} a JOIN pt ON pt.r = a.r AND pt.p = a.p GROUP BY pt.p, m.k) s ON s.p = c.p AND s.k = c.k"
OP11 = f"""WITH e AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id) AS r FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
pt AS MATERIALIZED (SELECT r, p, {_X} FROM (SELECT r, v, unnest(range(16)) AS p FROM e)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS k, x1 AS c1, x2 AS c2, x3 AS c3, x4 AS c4 FROM pt WHERE r <= 64),
a0 AS MATERIALIZED ({_CHOSEN.format('c0')}), c1 AS MATERIALIZED ({_NEXT.format('c0', 'a0')}),
a1 AS MATERIALIZED ({_CHOSEN.format('c1')}), c2 AS MATERIALIZED ({_NEXT.format('c1', 'a1')}),
a2 AS MATERIALIZED ({_CHOSEN.format('c2')}),
o AS (SELECT r, string_agg(lower(printf('%02x', m.k)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY r),
j AS (SELECT vec_id, label, code, error FROM o JOIN e ON e.r = o.r),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM j GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(concat_ws(',', c1, c2, c3, c4), ',' ORDER BY p, k)) FROM c2) AS codebooks_sha256 FROM j JOIN l ON l.label IS NOT DISTINCT FROM j.label"""

_P = "1 + (1000000000::HUGEINT * ({0} + 5)) // ({1} + 5 * v)"
OP12 = f"""WITH d AS MATERIALIZED (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_FOLD} AS text, row_number() OVER () AS r FROM documents),
t AS MATERIALIZED (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS MATERIALIZED (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
g AS MATERIALIZED (SELECT g.lang, g.source, coalesce(ng.n, 0) AS total, coalesce(nl.n, 0) AS lang_total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) g
 LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) ng ON ng.lang = g.lang AND ng.source = g.source LEFT JOIN (SELECT lang, sum(n) AS n, count(*) AS v FROM k GROUP BY lang) nl ON nl.lang = g.lang),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format('coalesce(c.n, 0)', 'total')} AS p, {_P.format('k.n', 'lang_total')} AS q FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
 UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM a) WHERE part = 'pair' OR rank <= 50"""

ORACLE |= {"op11_vector_codes": OP11, "op12_source_divergence": OP12}

"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(n_bytes - 49, 0))) AS p, h FROM b),
g AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM w),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT g.doc_id, g.p FROM g JOIN f USING (s) WHERE g.doc_id > f.least),
m AS (SELECT doc_id, p, max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM hit),
i AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM m),
span AS (SELECT doc_id, k, min(p) AS s, max(p) + 50 AS e FROM i GROUP BY doc_id, k),
gap AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM span),
per AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(e) AS last FROM span GROUP BY doc_id),
kept AS (SELECT gap.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS front FROM gap JOIN b USING (doc_id) GROUP BY gap.doc_id)
SELECT b.doc_id, b.n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP4 = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM t),
w AS (SELECT doc_id, k, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS s FROM l),
f AS (SELECT s, min((doc_id, k)) AS least, row_number() OVER () AS id FROM w WHERE len(s) > 0 GROUP BY s),
e AS (SELECT id, least, len(s) AS n, unnest(s) AS word FROM f),
z AS (SELECT e.*, df FROM e JOIN (SELECT word, count(*) AS df FROM e GROUP BY word) USING (word)),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY df, word) AS r FROM z),
x AS (SELECT * FROM o WHERE r <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b USING (word) WHERE a.least < b.least AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
v AS (SELECT DISTINCT b FROM c JOIN f p ON p.id = a JOIN f q ON q.id = b
      WHERE 100 * len(list_intersect(p.s, q.s)) >= 80 * (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s)))),
g AS (SELECT w.doc_id, w.k FROM w JOIN f USING (s) WHERE (w.doc_id, w.k) <> f.least OR f.id IN (SELECT b FROM v)),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.k) AS kept FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY l.doc_id)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_lines_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) USING (doc_id)
"""

_SKETCH = """
 list_sort(list_distinct(list_transform(CASE WHEN len({h}) = 0 THEN [] WHEN len(list_filter({h}, lambda x: x < '2')) > 0 THEN list_filter({h}, lambda x: x < '2') ELSE [list_min({h})] END, lambda x: substr(x, 1, 16))))
"""
_HASHES = """
 CASE WHEN len({w}) = 0 THEN []::VARCHAR[] WHEN len({w}) < 5 THEN [md5(array_to_string({w}, ' '))]
 ELSE list_transform(range(1, len({w}) - 3), lambda i: md5(array_to_string({w}[i:i + 4], ' '))) END
"""
_WORDS = "regexp_extract_all({t}, '[^\\x20\\x09-\\x0D]+')"
_LIKE = "CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b})))::DOUBLE END::DOUBLE"
OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT doc_id, n, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS nt, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS nid FROM d WINDOW o AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, n, nid, text, substr(text, 1, n - n // 2) || substr(nt, 1, n // 2) AS edited FROM x),
w AS (SELECT *, {_WORDS.format(t="text")} AS w1, {_WORDS.format(t="edited")} AS w2 FROM e),
h AS (SELECT *, {_HASHES.format(w="w1")} AS h1, {_HASHES.format(w="w2")} AS h2 FROM w),
s AS (SELECT *, {_SKETCH.format(h="h1")} AS s1, {_SKETCH.format(h="h2")} AS s2 FROM h)
SELECT s.doc_id, s.n::BIGINT AS n_chars, sha256(s.edited) AS edited_sha256, array_to_string(s.s1, ',') AS fingerprint, array_to_string(s.s2, ',') AS edited_fingerprint,
       {_LIKE.format(a="s.s1", b="s.s2")} AS near_edited, {_LIKE.format(a="s.s1", b="t.s1")} AS near_next
FROM s JOIN s t ON t.doc_id = s.nid
"""

_TOKENS = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"
_GRAMS = "list_distinct(list_transform(range(1, len({w}) - least(5, len({w})) + 2), lambda i: array_to_string({w}[i:i + least(5, len({w})) - 1], ' ')))"
_HITS = "len(list_filter({g}, lambda g: contains(' ' || p.s || ' ', ' ' || g || ' ')))::BIGINT"
OP6 = rf"""
WITH q AS (SELECT item_id, text, regexp_extract(trim(text, E' \n\t\r'), '(?s)^(.*[.!?])\s+(\S.*)$', ['q', 'a']) AS x FROM benchmark),
i AS (SELECT item_id, {_TOKENS.format(t="text")} AS w, {_TOKENS.format(t="CASE WHEN x.a = '' THEN text ELSE x.q END")} AS qw, {_TOKENS.format(t="CASE WHEN x.a = '' THEN text ELSE x.a END")} AS aw FROM q),
k AS (SELECT item_id, w, len(w) AS n, {_GRAMS.format(w="qw")} AS qg, {_GRAMS.format(w="aw")} AS ag FROM i WHERE len(w) > 0),
c AS (SELECT count(*) AS items, avg(n) AS avgdl, max(n) AS stride FROM k),
tf AS (SELECT item_id, n, term, count(*) AS tf FROM (SELECT item_id, n, unnest(w) AS term FROM k) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
m AS (SELECT item_id, term, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avgdl)) AS v FROM tf JOIN df USING (term), c),
v AS (SELECT item_id, term, v / sum(v) OVER (PARTITION BY item_id) AS v FROM m),
d AS (SELECT doc_id, {_TOKENS.format(t="text")} AS w FROM documents),
b AS (SELECT doc_id, w, stride, unnest(range(0, greatest(ceil((len(w) - 2 * stride) / stride), 0)::BIGINT + 1)) AS j FROM d, c WHERE len(w) > 0),
p AS (SELECT doc_id, j, w[j * stride + 1:j * stride + 2 * stride] AS w, array_to_string(w[j * stride + 1:j * stride + 2 * stride], ' ') AS s FROM b),
u AS (SELECT doc_id, j, unnest(list_distinct(w)) AS term FROM p),
r AS (SELECT doc_id, j, item_id FROM u JOIN v USING (term) GROUP BY ALL HAVING sum(v) >= 0.6 - 1e-9),
h AS (SELECT r.doc_id, r.item_id, {_HITS.format(g="qg")} AS qh, len(qg)::BIGINT AS qn, {_HITS.format(g="ag")} AS ah, len(ag)::BIGINT AS an FROM r JOIN p USING (doc_id, j) JOIN k USING (item_id))
SELECT doc_id, item_id, count(*)::BIGINT AS passages, max(qh) AS question_hits, max(qn) AS question_grams, max(ah) AS answer_hits, max(an) AS answer_grams
FROM h WHERE qn > 0 AND an > 0 AND qh >= 0.5 * qn AND ah >= 0.5 * an GROUP BY doc_id, item_id
"""

OP7 = r"""
WITH RECURSIVE
t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS z FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.z)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.z AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(z) AS z FROM r GROUP BY doc_id) m USING (doc_id)
"""

OP8 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 12, 0) + 1)) AS i FROM t),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS s FROM p),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT DISTINCT g.doc_id, g.i + k AS j FROM g JOIN f USING (s), (SELECT unnest(range(13)) AS k) WHERE g.doc_id > f.least),
per AS (SELECT doc_id, list(j) AS gone FROM hit GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM t),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.j) AS k FROM u ANTI JOIN hit ON u.doc_id = hit.doc_id AND u.j = hit.j GROUP BY u.doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""



def _kmeans(k: int = 40, rounds: int = 5) -> str:
    """Plain Lloyd rounds: every vector against every centroid."""
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS r FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM k) WHERE c < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT r, min((d, c)) AS m FROM (SELECT k.r, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d "
            f"FROM k CROSS JOIN c{n} c) GROUP BY r)"
        )
        if n < rounds:
            steps.append(
                f"n{n} AS (SELECT c, list(f ORDER BY j) AS v FROM (SELECT c, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS f FROM "
                f"(SELECT m[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{n} JOIN k USING (r)) GROUP BY c, j) GROUP BY c)"
            )
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{n} c LEFT JOIN n{n} n USING (c))")
    steps.append(f"z AS (SELECT vec_id, m[2]::INT AS cluster, m[1]::BIGINT AS distance FROM a{rounds} JOIN k USING (r))")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM z JOIN c{rounds} c ON c.c = z.cluster
"""


OP12 = _kmeans()

ORACLE = {"op1_suffix_dedup": OP1, "op4_line_dedup": OP4, "op5_scaled_fingerprints": OP5, "op6_bm25_decontamination": OP6, "op7_partenum_join": OP7, "op8_super_kmers": OP8, "op12_geometric_kmeans": OP12}

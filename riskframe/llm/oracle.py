"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op2_decontamination"] = r"""
WITH bench AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t
  FROM benchmark WHERE text IS NOT NULL),
b AS (SELECT item_id, len(t) AS n, unnest(t) AS tok, unnest(range(len(t))) AS p
      FROM bench WHERE len(t) >= 9),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t
  FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, unnest(t) AS tok, unnest(range(len(t))) AS q FROM docs),
m AS (SELECT r, doc_id, item_id, n, q - p AS diag, p FROM d JOIN b USING (tok)),
w AS (SELECT r, doc_id, item_id, n, diag,
             count(*) OVER (PARTITION BY r, item_id, diag ORDER BY p
                            RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM m)
SELECT doc_id, item_id, max(k) AS n_match, min(diag) AS diagonal FROM w
WHERE k >= CASE WHEN n < 13 THEN n ELSE 11 END GROUP BY doc_id, item_id
"""

# an escape adds one backslash per (escaped) control string of a role or text
_ESCAPED = (r"length(regexp_replace(regexp_replace({0}, '<(\\*)(/?s>)', '<\\\1\2', 'g'), "
            r"'\[(\\*)(/?INST\])', '[\\\1\2', 'g'))")
SQL["op3_chat_format"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, role, text)
                  FILTER (WHERE role = 'assistant'), '') AS loss,
         3 + sum(17 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')}) AS formatted
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM g
"""

SQL["op5_embedding_join"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, label, e FROM v
       WHERE label IS NOT NULL AND len(e) > 0
         AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r, b.r AS o FROM ok a JOIN ok b
      ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(r, o) AS (SELECT r, o FROM l UNION SELECT reach.r, l.o FROM reach JOIN l ON reach.o = l.r),
n AS (SELECT r, count(*) AS k FROM l GROUP BY r),
c AS (SELECT reach.r, min(v.vec_id) AS least FROM reach JOIN v ON v.r = reach.o GROUP BY reach.r)
SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM v LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""

SQL["op6_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w
  FROM documents),
s AS (SELECT DISTINCT r, unnest(list_transform(range(greatest(len(w) - 4, 1)),
                         lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS g
      FROM d WHERE len(w) > 0),
z AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r, b.r AS o, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT c.r, c.o FROM c JOIN z x ON x.r = c.r JOIN z y ON y.r = c.o
      WHERE c.k * 10 >= 8 * (x.n + y.n - c.k)),
reach(r, o) AS (SELECT r, o FROM l UNION SELECT reach.r, l.o FROM reach JOIN l ON reach.o = l.r),
m AS (SELECT r, count(*) AS k FROM l GROUP BY r),
b AS (SELECT reach.r, min(d.doc_id) AS least FROM reach JOIN d ON d.r = reach.o GROUP BY reach.r)
SELECT doc_id, least(doc_id, coalesce(b.least, doc_id)) AS class_id, coalesce(m.k, 0) AS n_links,
       doc_id = least(doc_id, coalesce(b.least, doc_id)) AS kept
FROM d LEFT JOIN m USING (r) LEFT JOIN b USING (r)
"""

SQL["op7_line_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, text,
                     string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, source, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM docs),
spread AS (SELECT line FROM l WHERE trim(line, ' ') <> '' GROUP BY line
           HAVING count(DISTINCT source) >= 5),
marked AS (SELECT l.r, l.line, l.k, spread.line IS NOT NULL AS gone
           FROM l LEFT JOIN spread ON l.line = spread.line),
per AS (SELECT r, count(*) FILTER (WHERE gone) AS n_gone,
               count(*) FILTER (WHERE NOT gone AND trim(line, ' ') <> '') AS n_own,
               coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS kept
        FROM marked GROUP BY r),
bare AS (SELECT r, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w
         FROM docs JOIN per USING (r) WHERE n_gone > 0 AND n_own = 0),
s AS (SELECT DISTINCT r, unnest(list_transform(range(greatest(len(w) - 4, 1)),
                         lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS g
      FROM bare WHERE len(w) > 0),
z AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r, b.r AS o, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
copies AS (SELECT DISTINCT c.r FROM c JOIN z x ON x.r = c.r JOIN z y ON y.r = c.o
           WHERE c.k * 10 >= 8 * (x.n + y.n - c.k)),
final AS (SELECT docs.*, per.kept, per.n_gone, n_gone > 0 AND copies.r IS NULL AS acts
          FROM docs LEFT JOIN per USING (r) LEFT JOIN copies USING (r))
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines,
       CASE WHEN acts THEN n_gone ELSE 0 END AS n_removed,
       sha256(CASE WHEN acts THEN kept ELSE text END) AS text_sha256
FROM final
"""

SQL["op10_url_filter"] = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rule, verdict, h, f) AS (VALUES
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule,
         arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f)
  GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.page_id = best.page_id AND p.host = best.host AND p.path = best.path
"""


def _lloyd(parts: int, width: int, entries: int, rounds: int) -> str:
    """Vector codes by full scans, one set of relations per round."""
    sql = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT r, p, list_transform(embedding[p * {width} + 1:(p + 1) * {width}],
                              lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w
  FROM v, (SELECT unnest(range({parts})) AS p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, w FROM x WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        sql.append(f"""b{k} AS (
  SELECT r, x.p, x.w, min(CAST(list_inner_product(x.w, x.w) - 2 * list_inner_product(x.w, c.w)
                               + list_inner_product(c.w, c.w) AS BIGINT) * {entries} + e) AS m
  FROM x JOIN c{k} c ON x.p = c.p GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT r, p, w, m % {entries} AS e, m // {entries} AS d FROM b{k})""")
        if k < rounds:
            sql.append(f"""u{k} AS (
  SELECT p, e, i, count(*) AS n, sum(CAST(w[i] AS BIGINT)) AS s
  FROM a{k}, (SELECT unnest(range(1, {width + 1})) AS i) GROUP BY ALL),
n{k} AS (SELECT p, e, list(CAST((s - (s % n + n) % n) // n AS DOUBLE) ORDER BY i) AS w
         FROM u{k} GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.w, c.w) AS w FROM c{k} c LEFT JOIN n{k} n USING (p, e))""")
    return f"""WITH {(',' + chr(10)).join(sql)},
coded AS (SELECT r, string_agg(format('{{:02x}}', CAST(e AS BIGINT)), '' ORDER BY p) AS code,
                 CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
flat AS (SELECT p, e, unnest(w) AS x, unnest(range(len(w))) AS i FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) FROM flat)
         AS codebooks_sha256
FROM v JOIN coded USING (r)"""


SQL["op12_vector_codes"] = _lloyd(parts=4, width=16, entries=256, rounds=4)

SQL["op13_periodic_runs"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
               list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z:
               CASE WHEN u % 2 = 1 THEN xor(u >> 1, CAST(3988292384 AS BIGINT)) ELSE u >> 1 END)),
           CAST(4294967295 AS BIGINT)) AS h
  FROM documents),
g AS (SELECT r, doc_id, w, coalesce(len(w), 0) AS n, h, h // 10 AS g FROM d),
k AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a,
             CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM g),
i AS (SELECT r, n, h, a, p, w, unnest(range(n)) AS i FROM k),
t AS MATERIALIZED (
  SELECT r, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x FROM i),
same AS (SELECT s.r, s.i, o.i - s.i AS q FROM t s JOIN t o
         ON s.r = o.r AND s.x = o.x AND o.i > s.i AND (o.i - s.i) * 4 <= s.n),
marked AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same),
long AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM marked GROUP BY r, q, island
         HAVING count(*) >= greatest(6, 4 * q) - q),
runs AS MATERIALIZED (
  SELECT r, q, s, len FROM long o WHERE NOT EXISTS (
    SELECT 1 FROM long f WHERE f.r = o.r AND f.q < o.q AND f.s <= o.s AND f.s + f.len >= o.s + o.len)),
per AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed
        FROM runs GROUP BY r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (
           PARTITION BY r ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) = 1),
left_over AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (
                SELECT 1 FROM runs WHERE runs.r = t.r AND t.i >= s + q AND t.i < s + len) GROUP BY r)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) AS length,
       CAST(q AS BIGINT) AS period, CAST(1000 * len // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (r) LEFT JOIN best USING (r) LEFT JOIN left_over USING (r)
"""

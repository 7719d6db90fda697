"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOKENS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SPACED_LOWER = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+')"

OP2 = """WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.a AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n ON n.a = c.a"""

OP4 = f"""WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 35], ' ') AS win FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 34, 0))) AS s FROM d)),
m AS (SELECT win FROM s GROUP BY win HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM s JOIN m USING (win))),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) FILTER (WHERE g.p IS NULL) AS kept, count(g.p) AS gone
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d) x LEFT JOIN g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP5 = f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), i AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 10], ' ') AS win, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d CROSS JOIN z)),
h AS (SELECT DISTINCT dw.doc_id, iw.item_id, dw.s, dw.n FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP6 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_SPACED_LOWER} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[s + 1 : s + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""

OP10 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), h AS (SELECT *, sha1(body) AS hex, sha256(body) AS strong FROM p),
e AS (SELECT strong, max(page_id) AS elected FROM h GROUP BY strong)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = elected THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> elected THEN elected END AS refers_to
FROM h JOIN e USING (strong)"""

#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT),
        lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
_STEP = lambda p: f"pow(10, -round(-log10({p}) * 4096) / 4096)"
OP11 = f"""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, list_append({_SPACED_LOWER}, '') AS w FROM documents),
h AS (SELECT doc_id, w, {_CRC32} % 7 = 2 AS held_out FROM d),
t AS (SELECT doc_id, held_out, i, w[i] AS w, CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS v, CASE WHEN i = 2 THEN '' WHEN i > 2 THEN w[i - 2] END AS u FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM h)),
c1 AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c1),
c2 AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY v, w), k2 AS (SELECT v, sum(c) AS c, count(*) AS types FROM c2 GROUP BY v),
c3 AS (SELECT u, v, w, count(*) AS c FROM t WHERE NOT held_out AND u IS NOT NULL GROUP BY u, v, w), k3 AS (SELECT u, v, sum(c) AS c, count(*) AS types FROM c3 GROUP BY u, v),
p AS (SELECT t.doc_id, t.held_out, c1.c AS known, n.n, (coalesce(c1.c, 0) + 1) / (n.n + n.v + 1) AS p1,
        CASE WHEN c2.c IS NULL THEN 0 ELSE {_STEP("(c2.c - 0.75) / k2.c")} END AS own2, CASE WHEN k2.c IS NULL THEN 1 ELSE {_STEP("0.75 * k2.types / k2.c")} END AS rest2,
        CASE WHEN c3.c IS NULL THEN 0 ELSE {_STEP("(c3.c - 0.75) / k3.c")} END AS own3, CASE WHEN k3.c IS NULL THEN 1 ELSE {_STEP("0.75 * k3.types / k3.c")} END AS rest3
      FROM t CROSS JOIN n LEFT JOIN c1 ON c1.w = t.w LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w LEFT JOIN k2 ON k2.v = t.v
      LEFT JOIN c3 ON c3.u = t.u AND c3.v = t.v AND c3.w = t.w LEFT JOIN k3 ON k3.u = t.u AND k3.v = t.v)
SELECT doc_id, held_out, count(*) AS n_tokens, count(known) AS n_known, n AS train_tokens, round(fsum(log10(p1)), 6) AS base_score, round(fsum(log10(own3 + rest3 * (own2 + rest2 * p1))), 6) AS score
FROM p GROUP BY doc_id, held_out, n"""

_HASH = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS UBIGINT)"
OP12 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST({_HASH(0)} % (len(u) + 1) AS BIGINT) AS x, CAST({_HASH(1)} % (len(u) + 1) AS BIGINT) AS y,
        body = '' OR regexp_matches(body, '<[PSM]>') OR {_HASH(2)} % 100 >= 50 AS plain, {_HASH(3)} % 100 < 80 AS swap FROM d),
p AS (SELECT doc_id, body, n, CASE WHEN plain THEN 'plain' WHEN swap THEN 'spm' ELSE 'psm' END AS form, array_to_string(u[1 : least(x, y)], '') AS a, array_to_string(u[least(x, y) + 1 : greatest(x, y)], '') AS b,
        array_to_string(u[greatest(x, y) + 1 : n], '') AS e FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'spm' THEN concat('<S>', e, '<P>', a, '<M>', b) ELSE concat('<P>', a, '<S>', e, '<M>', b) END) AS output_sha256, sha256(body) AS restored_sha256
FROM p"""

ORACLE_SQL = {"op2_embedding_dedup": OP2, "op4_substring_dedup": OP4, "op5_decontaminate": OP5, "op6_ngram_jaccard": OP6, "op10_warc_archive": OP10, "op11_lm_scoring": OP11, "op12_fill_in_middle": OP12}

"""SQL that DuckDB runs over the same tables, by other routes than the operators'."""

WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op5_warc_zstd": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h""",
    "op7_preference_format": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, max(i) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT t.conv_id, text AS reply FROM t JOIN a ON t.conv_id = a.conv_id AND i = last),
o AS (SELECT conv_id, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS following FROM r),
b AS (SELECT t.conv_id, i, t.role, t.text AS chosen, CASE WHEN i = last THEN reply ELSE t.text END AS rejected, last, reply IS NOT DISTINCT FROM (CASE WHEN i = last THEN t.text ELSE reply END) AS same
  FROM t JOIN a ON t.conv_id = a.conv_id JOIN o ON t.conv_id = o.conv_id JOIN r ON r.conv_id = o.following),
n AS (SELECT conv_id, CASE WHEN bool_and(same) THEN max(i) ELSE any_value(last) - 1 END AS n FROM b GROUP BY conv_id),
m AS (SELECT b.*, n, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS head, replace(coalesce(chosen, ''), '<|', '< |') || '<|end|>' || chr(10) AS x, replace(coalesce(rejected, ''), '<|', '< |') || '<|end|>' || chr(10) AS y FROM b JOIN n ON b.conv_id = n.conv_id),
s AS (SELECT *, sum(CASE WHEN i > n THEN length(head) + length(x) ELSE 0 END) OVER w - length(x) AS sx, sum(CASE WHEN i > n THEN length(head) + length(y) ELSE 0 END) OVER w - length(y) AS sy FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id, any_value(n) AS n_prefix, coalesce(string_agg(head || x, '' ORDER BY i) FILTER (i <= n), '') AS prompt,
  coalesce(string_agg(head || x, '' ORDER BY i) FILTER (i > n), '') AS chosen_text, coalesce(string_agg(CAST(sx AS VARCHAR) || '+' || CAST(length(x) AS VARCHAR), ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS chosen_learnt,
  coalesce(string_agg(head || y, '' ORDER BY i) FILTER (i > n), '') AS rejected_text, coalesce(string_agg(CAST(sy AS VARCHAR) || '+' || CAST(length(y) AS VARCHAR), ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS rejected_learnt
FROM s GROUP BY conv_id""",
    "op8_line_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('s' || source, '') AS host FROM documents),
w AS (SELECT r, doc_id, host, text, regexp_extract_all(text, '{WORD}') AS w FROM d),
g AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS g FROM w, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8),
f AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM f, (SELECT unnest(range(8)) AS k) GROUP BY r),
l AS (SELECT r, doc_id, host, text, p, line, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm FROM (SELECT r, doc_id, host, text, generate_subscripts(string_split(text, chr(10)), 1) AS p, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}')),
u AS (SELECT host, norm FROM l GROUP BY host, norm HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'no id: ' || text)) > 20),
x AS (SELECT r, sum(len(regexp_extract_all(line, '{WORD}'))) AS lost, count(*) AS gone FROM l JOIN u ON l.host = u.host AND l.norm = u.norm GROUP BY r),
y AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM l GROUP BY r),
z AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_words, CAST(coalesce(gone, 0) AS BIGINT) AS removed_lines FROM w LEFT JOIN c ON w.r = c.r LEFT JOIN x ON w.r = x.r LEFT JOIN y ON w.r = y.r)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_words <= 0.8 * n_words AS kept FROM z""",
    "op9_bottom_k": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 2, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
v AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT c.node, v.b FROM c JOIN v ON c.reached = v.a),
m AS (SELECT node, min(reached) AS component_id FROM c GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON d.doc_id = m.node LEFT JOIN n ON d.doc_id = n.doc_id""",
    # Trees by recursion: level by level all nodes of a language (as the row number of its name), then of the
    # subroots; a row's siblings are looked up at each level, and its leaf is folded with them.
    "op11_merkle_manifest": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
  coalesce(list_reduce(list_prepend(4294967295::BIGINT, [ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT FOR i IN range(1, length(CAST(doc_id AS VARCHAR)) + 1)]), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967294) AS c FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
l AS (SELECT r, doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN xor(c, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS tampered
  FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
t AS (SELECT 0 AS level, g, pos, n, leaf AS h FROM l UNION ALL SELECT level + 1, g, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, g, pos // 8, n),
s AS (SELECT g, h AS subroot, (SELECT count(*) FROM g) AS k FROM t WHERE n = 1),
u AS (SELECT 0 AS level, g AS pos, k AS n, subroot AS h FROM s UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 8, n),
e AS (SELECT l.r, t.level AS level, l.pos >> (3 * t.level) AS own, t.pos AS pos, h FROM l JOIN t ON l.g = t.g AND t.n > 1 AND t.pos // 8 = l.pos >> (3 * t.level + 3)
  UNION ALL SELECT l.r, 100 + u.level, l.g >> (3 * u.level), u.pos, h FROM l JOIN u ON u.n > 1 AND u.pos // 8 = l.g >> (3 * u.level + 3)),
p AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY level) AS step, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < own), '') AS a, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > own), '') AS b, count(*) - 1 AS others FROM e GROUP BY r, level),
q AS (SELECT r, string_agg(a || b, '' ORDER BY step) AS proof, sum(others) AS proof_nodes FROM p GROUP BY r),
f AS (SELECT r, 0::BIGINT AS step, tampered AS h FROM l UNION ALL SELECT f.r, p.step, sha256(a || f.h || b) FROM f JOIN p ON f.r = p.r AND p.step = f.step + 1),
z AS (SELECT r, arg_max(h, step) AS folded_root FROM f GROUP BY r)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM u WHERE n = 1) AS verified, CAST(coalesce(proof_nodes, 0) AS INTEGER) AS proof_nodes
FROM l JOIN s ON l.g = s.g LEFT JOIN q ON l.r = q.r JOIN z ON l.r = z.r""",
    "op12_ranked_search": r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM w WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
f AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, nd),
s AS (SELECT item_id, d.r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt))))::BIGINT AS score FROM i JOIN p ON i.term = p.term JOIN f ON i.term = f.term JOIN d ON p.r = d.r, c GROUP BY item_id, d.r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 50""",
    "op13_exact_dedup": r"""
WITH n AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
o AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS nth FROM n WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM o""",
}

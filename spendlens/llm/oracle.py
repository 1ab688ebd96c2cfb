"""DuckDB SQL with the same rows, for the queries that SQL can express on whole tables."""

from __future__ import annotations

OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
     f AS (SELECT h, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (h)
"""

USABLE = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e,
             embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings)
"""

OP4 = f"""
WITH RECURSIVE {USABLE},
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.ok AND b.ok AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.y FROM r JOIN l ON r.seen = l.x),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.node LEFT JOIN n ON v.vec_id = n.x
"""

OP5 = f"""
WITH {USABLE},
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS score
      FROM v a JOIN v b ON a.ok AND b.ok AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
"""

OP7 = """
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
                          WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                     END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, l.y FROM r JOIN l ON r.seen = l.x)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, min(r.seen) AS component_id,
       coalesce(any_value(k.class_id), s.doc_id) AS class_id, coalesce(any_value(c.n_links), 0)::BIGINT AS n_links
FROM s JOIN r ON s.doc_id = r.node
LEFT JOIN (SELECT list_sort(shingles) AS sorted, min(doc_id) AS class_id FROM s WHERE len(shingles) > 0
           GROUP BY list_sort(shingles)) k ON k.sorted = list_sort(s.shingles)
LEFT JOIN (SELECT x, count(*) AS n_links FROM l GROUP BY x) c ON s.doc_id = c.x
GROUP BY s.doc_id, s.shingles
"""

OP8 = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
     l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM s),
     k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10
           GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
     m AS (SELECT k.*, coalesce(doc_id <> keeper, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP10 = """
WITH RECURSIVE
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
             ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
      FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, h) AS copy FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
             [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
      FROM d GROUP BY source),
rounds AS (
  SELECT 0 AS i, source, source_size, cap, w, false AS clamped FROM s
  UNION ALL
  SELECT i + 1, source, source_size, cap, w, clamped OR cap <= w * (
           1.5 * sum(source_size) OVER () - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ())
           / sum(CASE WHEN clamped THEN 0 ELSE w END) OVER ()
  FROM rounds WHERE i < (SELECT count(*) FROM s)),
settled AS (SELECT * FROM rounds WHERE i = (SELECT count(*) FROM s)),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap ELSE w * (
           (1.5 * sum(source_size) OVER () - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ())
           / nullif(sum(CASE WHEN clamped THEN 0 ELSE w END) OVER (), 0)) END AS target FROM settled),
p AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole FROM t),
m AS (SELECT e.*, source_size, target, whole, sum(size) OVER (PARTITION BY e.source ORDER BY h, copy) - size / 2
             <= target - whole * source_size AS more
      FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source),
t2 AS (SELECT *, whole + CASE WHEN more AND whole < 2 THEN 1 ELSE 0 END AS repeats FROM m)
SELECT doc_id, size::BIGINT AS size, source_size, target, source, repeats::BIGINT AS repeats, (size * repeats)::BIGINT AS taken
FROM t2
"""

# The checksum byte by byte from a table; the letters of a run take one or two bytes each.
OP11 = """
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i:
          CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
many AS (SELECT doc, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY doc, run),
bytes AS (SELECT doc, run, k, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c:
            CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM many),
hashed AS (SELECT run, k, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295::BIGINT), 4294967295) AS h
           FROM bytes, crc),
drawn AS (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2)
                         ELSE run END AS word FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n FROM drawn WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
swap AS (SELECT word, n, i, left(word, i - 1) || '_' || substr(word, i + 1) AS rest FROM p),
less AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS rest FROM p),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM swap a JOIN swap b ON a.rest = b.rest AND a.word <> b.word
         UNION SELECT less.word, v.word, v.n FROM less JOIN v ON less.rest = v.word
         UNION SELECT v.word, less.word, less.n FROM less JOIN v ON less.rest = v.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 10 * n THEN other END AS form,
             CASE WHEN top >= 10 * n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS reached, 0 AS step FROM f
          UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.reached WHERE f.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n, r.root
FROM f JOIN (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word) r ON f.word = r.word
"""

OP13 = """
WITH
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS term FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS all_terms FROM d WHERE len(terms) > 0),
t AS (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM t SEMI JOIN b ON t.term = b.term GROUP BY doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term),
s AS (SELECT item_id, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // all_terms))))::BIGINT AS score
      FROM tf JOIN w USING (term) JOIN b USING (term), g GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLE: dict[str, str] = {"op13_lexical_search": OP13, "op11_spelling": OP11, "op1_warc": OP1, "op4_vector_pairs": OP4, "op5_vector_search": OP5, "op7_ngram_join": OP7, "op8_line_dedup": OP8, "op10_mixing": OP10}


def oracle() -> dict[str, str]:
    return dict(ORACLE)

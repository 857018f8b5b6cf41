"""DuckDB statements for the corpus queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op1_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS max_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AND l.doc_id <> c.max_doc AS gone
  FROM keyed l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SQL["op4_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 3))::INT AS cell
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) AS k
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM src
), turned AS (
  SELECT *, row_number() OVER (ORDER BY most / w, k) AS turn FROM weighed
), level AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w
  FROM turned
), first_free AS (
  SELECT turn AS t, rest AS r, rest_w AS rw FROM level WHERE most * rest_w > rest * w ORDER BY turn LIMIT 1
), goal AS (
  SELECT source, source_size, CASE WHEN turn >= t THEN w * r / rw ELSE most END AS target
  FROM level LEFT JOIN first_free ON true
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM goal
), wanted AS (
  SELECT *, floor(rate)::INT AS whole, (rate - floor(rate)) * source_size AS want FROM rated
), cells AS (
  SELECT source, cell, sum(size) AS cw FROM sized GROUP BY source, cell
), steps AS (
  SELECT source, 0 AS threshold, want AS gap FROM wanted
  UNION ALL
  SELECT c.source, c.cell + 1, abs(sum(c.cw) OVER (PARTITION BY c.source ORDER BY c.cell) - w.want)
  FROM cells c JOIN wanted w ON c.source IS NOT DISTINCT FROM w.source
), best AS (
  SELECT source, threshold FROM steps QUALIFY row_number() OVER (PARTITION BY source ORDER BY gap, threshold) = 1
)
SELECT s.doc_id, s.size, w.source_size, w.target, (s.size * (w.whole + CASE WHEN s.cell < b.threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source JOIN best b ON s.source IS NOT DISTINCT FROM b.source
"""

SQL["op10_exact_dedup"] = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""

SQL["op11_fingerprint"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC) AS pos FROM documents
), f AS (
  SELECT a.doc_id, a.t, a.pos, length(a.t) // 3 AS k, b.t AS nt, b.pos AS npos
  FROM d a JOIN d b ON b.pos = CASE WHEN a.pos = (SELECT max(pos) FROM d) THEN 1 ELSE a.pos + 1 END
), e AS (
  SELECT *, substr(t, 1, length(t) - k) || substr(nt, 1, k) AS et FROM f
), texts AS (
  SELECT pos, 0 AS kind, t AS x FROM e UNION ALL SELECT pos, 1, et FROM e
), bytes AS (
  SELECT pos, kind, hex(encode(x)) AS hx, octet_length(encode(x)) AS n FROM texts
), listed AS (
  SELECT pos, kind, n, list_transform(regexp_extract_all(hx, '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM bytes WHERE n >= 3
), places AS (
  SELECT pos, kind, unnest(list_zip(b[1:n - 2], b[2:n - 1], b[3:n], b[4:n])) AS z FROM listed
), quads AS (
  SELECT pos, kind, 65536 * z[1] + 256 * z[2] + z[3] AS abc, 65536 * z[1] + 256 * z[2] + z[4] AS abd, 65536 * z[1] + 256 * z[3] + z[4] AS acd FROM places
), triplets AS (
  SELECT pos, kind, unnest([abc, abd + 16777216, acd + 33554432]) AS t FROM quads
), counted AS (
  SELECT pos, kind, ((t * 2654435761) % 4294967296) // 16777216 AS bucket, count(*) AS c FROM triplets WHERE t IS NOT NULL GROUP BY ALL
), held AS (
  SELECT pos, kind, b.bucket, coalesce(c, 0) AS c
  FROM bytes CROSS JOIN (SELECT unnest(range(256)) AS bucket) b LEFT JOIN counted USING (pos, kind, bucket)
), sorted AS (
  SELECT pos, kind, list_sort(list(c)) AS s FROM held GROUP BY ALL
), coded AS (
  SELECT pos, kind, bucket, (c > s[64])::INT + (c > s[128])::INT + (c > s[192])::INT AS code FROM held JOIN sorted USING (pos, kind)
), digests AS (
  SELECT pos, kind, list(code ORDER BY bucket) AS codes FROM coded GROUP BY ALL
), marks AS (
  SELECT pos, kind, codes, length(bin(n + 1)) - 1 AS e, n FROM digests JOIN bytes USING (pos, kind)
), made AS (
  SELECT pos, kind, codes, least(255, 8 * e + ((((n + 1) * 8) >> e) & 7)) AS lc FROM marks
), printed AS (
  SELECT *, lower(printf('%02x', lc) || list_aggregate(list_transform(range(128), lambda j: printf('%x', 4 * codes[2 * j + 1] + codes[2 * j + 2])), 'string_agg', '')) AS fp FROM made
), pairs AS (
  SELECT e.pos, 0 AS what, a.codes AS x, b.codes AS y, a.lc AS lx, b.lc AS ly, a.fp AS fx, b.fp AS fy
  FROM e JOIN printed a ON a.pos = e.pos AND a.kind = 0 JOIN printed b ON b.pos = e.pos AND b.kind = 1
  UNION ALL
  SELECT e.pos, 1, a.codes, b.codes, a.lc, b.lc, a.fp, b.fp
  FROM e JOIN printed a ON a.pos = e.pos AND a.kind = 0 JOIN printed b ON b.pos = e.npos AND b.kind = 0
), apart AS (
  SELECT *, list_sum(list_transform(range(1, 257), lambda i: abs(x[i] - y[i])))::BIGINT AS d,
         list_sum(list_transform(range(16), lambda c: abs(c // 4 - c % 4) * len(list_filter(x, lambda v: v = c // 4)) * len(list_filter(y, lambda v: v = c % 4))))::BIGINT AS u
  FROM pairs
), near AS (
  SELECT pos, what, CASE WHEN u = 0 THEN (fx = fy)::INT::DOUBLE
                         ELSE (1.0::DOUBLE - least(1.0::DOUBLE, (256 * d)::DOUBLE / u::DOUBLE)) * (1.0::DOUBLE - least(abs(lx - ly), 64)::DOUBLE / 128.0::DOUBLE) END AS v
  FROM apart
)
SELECT e.doc_id, length(e.t)::BIGINT AS n_chars, sha256(e.et) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
       n0.v AS near_edited, n1.v AS near_next
FROM e JOIN printed a ON a.pos = e.pos AND a.kind = 0 JOIN printed b ON b.pos = e.pos AND b.kind = 1
JOIN near n0 ON n0.pos = e.pos AND n0.what = 0 JOIN near n1 ON n1.pos = e.pos AND n1.what = 1
"""

SQL["op12_periodic_runs"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words,
         coalesce(xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
           lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT), 1) AS h
  FROM documents
), sized AS (
  SELECT *, len(words)::BIGINT AS n, h // 10 AS g FROM w
), placed AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized
), planned AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p, row_number() OVER () AS d FROM placed
), edited AS (
  SELECT d, doc_id, n, CASE WHEN a IS NULL THEN words
    ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % p + 1] END) END AS words
  FROM planned
), pos AS (
  SELECT d, n, unnest(words) AS word, unnest(range(n)) AS i FROM edited
), same AS (
  SELECT x.d, y.i - x.i AS q, x.i FROM pos x JOIN pos y ON x.d = y.d AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), isles AS (
  SELECT d, q, i, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS isle FROM same
), stretches AS (
  SELECT d, q, min(i) AS start, count(*) + q AS length FROM isles GROUP BY d, q, isle HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (
    SELECT 1 FROM stretches o WHERE o.d = s.d AND o.q < s.q AND o.start <= s.start AND o.start + o.length >= s.start + s.length)
), listed AS (
  SELECT d, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY d
), best AS (
  SELECT r.* FROM runs r WHERE NOT EXISTS (
    SELECT 1 FROM runs o WHERE o.d = r.d AND (o.length * r.q > r.length * o.q
      OR o.length * r.q = r.length * o.q AND (o.start < r.start OR o.start = r.start AND o.q < r.q)))
), gone AS (
  SELECT DISTINCT d, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (
  SELECT d, string_agg(word, ' ' ORDER BY i) AS text FROM pos ANTI JOIN gone USING (d, i) GROUP BY d
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.q::BIGINT AS period,
       ((1000 * b.length) // b.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM edited LEFT JOIN listed USING (d) LEFT JOIN best b USING (d) LEFT JOIN kept USING (d)
"""

SQL["op13_lexical_search"] = r"""
WITH item_words AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), items AS (
  SELECT item_id, term, count(*) AS times FROM item_words GROUP BY ALL
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), sized AS (
  SELECT r, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized
), held AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln(((2 * docs + 2)::DOUBLE) / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY term, docs
), scored AS (
  SELECT i.item_id, s.doc_id, s.r,
         sum(i.times * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * (100 - 25 + (25 * s.n * t.docs) // t.terms))))::BIGINT AS score
  FROM items i JOIN held h ON h.term = i.term JOIN weights w ON w.term = i.term JOIN sized s ON s.r = h.r, total t
  GROUP BY i.item_id, s.doc_id, s.r
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

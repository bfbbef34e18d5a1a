"""SQL of the training-data queries, written for DuckDB from the contracts, not from the operators."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM d, unnest(range(1, len(w) - 18)) u(i)),
heads AS (SELECT g, min(struct_pack(a := doc_id, b := i)) AS m FROM win GROUP BY g),
later AS (SELECT doc_id, i FROM win JOIN heads USING (g) WHERE m.a <> doc_id OR m.b <> i),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, range(20) t(k)),
ws AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) u(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM ws ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5_number(substring(h, 2 * i - 1, 200)) AS g FROM d, unnest(range(1, len(h) // 2 - 98)) u(i)),
heads AS (SELECT g, min(doc_id) AS a FROM win GROUP BY g),
first AS (SELECT win.g, a, min(i) AS b FROM win JOIN heads ON win.g = heads.g AND win.doc_id = a GROUP BY ALL),
later AS (SELECT doc_id, i FROM win JOIN first USING (g) WHERE a <> doc_id OR b <> i),
edge AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + 100, true) AS starts FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edge),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 99 AS b FROM numbered GROUP BY ALL),
pieces AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM spans),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - 1 - before)) || CASE WHEN next IS NULL THEN substring(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS t, count(*) AS n, sum(b - a + 1) AS removed FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y, n_both = p.n AND n_both = q.n AS same FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 5 * n_both >= 4 * (p.n + q.n - n_both)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = r)
SELECT d.doc_id, (SELECT min(r) FROM reach WHERE reach.doc_id = d.doc_id) AS class_id, (SELECT count(*) FROM links WHERE x = d.doc_id) AS n_links,
       1 + (SELECT count(*) FROM links WHERE x = d.doc_id AND same) AS n_copies, CAST(coalesce(n, 0) AS INTEGER) AS n_shingles FROM d LEFT JOIN n USING (doc_id)"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('a' || lang, 'n') AS lk, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) u(i)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT id, sum(least(8, coalesce(step, 8))) AS n FROM (SELECT id, lead(i) OVER (PARTITION BY id ORDER BY i) - i AS step FROM twice) GROUP BY id),
lines AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
c0 AS (SELECT *, regexp_replace(t, '\p{{Ll}}+', '', 'g') AS t1 FROM d), c1 AS (SELECT *, regexp_replace(t1, '[\x20\x09-\x0D]+', '', 'g') AS t2 FROM c0), c2 AS (SELECT *, regexp_replace(t2, '\p{{Lu}}+', '', 'g') AS t3 FROM c1),
c3 AS (SELECT *, regexp_replace(t3, '\p{{N}}+', '', 'g') AS t4 FROM c2), c4 AS (SELECT *, regexp_replace(t4, '[.,;:!?''"()-]+', '', 'g') AS t5 FROM c3),
f AS (SELECT c4.id, doc_id, lk, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
        length(t) AS n_chars, [length(t) - length(t1), length(t1) - length(t2), length(t2) - length(t3), length(t3) - length(t4), length(t4) - length(t5), length(t5)] AS cls FROM c4 LEFT JOIN lines USING (id) LEFT JOIN covered USING (id)),
good AS (SELECT *, greatest(1, least(10000, 10000 * 1000 // greatest(n_words, 1))) AS by_word, greatest(1, least(10000, 10000 * 6000 // greatest(n_chars, 1))) AS by_char
  FROM (SELECT any_value(f.id) AS id, f.lk, any_value(n_words) AS n_words, any_value(n_chars) AS n_chars, any_value(cls) AS cls FROM f JOIN d USING (id) WHERE n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words GROUP BY f.lk, d.t)),
short AS (SELECT id, lk, lower(x) AS word FROM (SELECT id, lk, unnest(w) AS x FROM d) WHERE length(x) <= 4),
ref AS (SELECT lk, sum(n_words * by_word) AS words, sum(list_sum(cls) * by_char) AS chars, sum(cls[1] * by_char) AS s1, sum(cls[2] * by_char) AS s2, sum(cls[3] * by_char) AS s3, sum(cls[4] * by_char) AS s4, sum(cls[5] * by_char) AS s5, sum(cls[6] * by_char) AS s6 FROM good GROUP BY lk HAVING sum(n_words) >= 5000),
common AS (SELECT lk, word, share FROM (SELECT s.lk, word, sum(by_word) / any_value(words) AS share, row_number() OVER (PARTITION BY s.lk ORDER BY sum(by_word) DESC, word) AS nth FROM short s JOIN good USING (id) JOIN ref ON ref.lk = s.lk GROUP BY s.lk, word HAVING sum(by_word) >= 0.0005 * any_value(words)) WHERE nth <= 24),
seen AS (SELECT id, word, count(*) AS n FROM short GROUP BY ALL),
both_words AS (SELECT f.id, c.word, coalesce(seen.n, 0) / n_words AS p, share AS q FROM f JOIN common c USING (lk) LEFT JOIN seen ON seen.id = f.id AND seen.word = c.word WHERE n_words >= 60
  UNION ALL SELECT f.id, NULL, greatest(0, 1 - sum(coalesce(seen.n, 0) / n_words)), greatest(0, 1 - sum(share)) FROM f JOIN common c USING (lk) LEFT JOIN seen ON seen.id = f.id AND seen.word = c.word WHERE n_words >= 60 GROUP BY f.id),
both_classes AS (SELECT id, unnest([cls[k] / n_chars FOR k IN [1, 2, 3, 4, 5, 6]]) AS p, unnest([s1 / chars, s2 / chars, s3 / chars, s4 / chars, s5 / chars, s6 / chars]) AS q FROM f JOIN ref USING (lk) WHERE n_chars >= 500),
dw AS (SELECT id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x FROM both_words GROUP BY id),
dc AS (SELECT id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x FROM both_classes GROUP BY id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(dc.x, 0) <= 0.22 AND coalesce(dw.x, 0) <= 0.355 AS kept FROM f LEFT JOIN dw USING (id) LEFT JOIN dc USING (id)"""

_QUOTE = r"^[ \t]*>(?:[ \t]*>)*[ \t]?"
QUOTES = rf"""
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, turn AS given, role, coalesce(text, '') AS text, coalesce('a' || conv_id, 'n') AS ck, coalesce(turn, 9223372036854775807) AS turn,
    md5(coalesce(role, '') || '|' || (role IS NULL) || '|' || coalesce(text, '') || '|' || (text IS NULL)) AS mid FROM conversations),
lines AS (SELECT ck, turn, mid, unnest(string_split_regex(text, '\r?\n')) AS raw, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS n FROM m),
marked AS (SELECT ck, turn, mid, n, length(regexp_replace(regexp_extract(raw, '{_QUOTE}'), '[^>]', '', 'g')) AS level, trim(regexp_replace(regexp_replace(raw, '{_QUOTE}', ''), '[\s\x{{a0}}\x0B]+', ' ', 'g')) AS words FROM lines),
broken AS (SELECT *, CASE WHEN lag(level) OVER p IS NULL OR lag(words) OVER p = '' OR lag(level) OVER p <> level THEN 1 ELSE 0 END AS starts FROM marked WINDOW p AS (PARTITION BY ck, turn, mid ORDER BY n)),
blocked AS (SELECT *, sum(starts) OVER (PARTITION BY ck, turn, mid ORDER BY n) AS block FROM broken),
passages AS (SELECT ck, turn, mid, block, level, lower(string_agg(words, ' ' ORDER BY n)) AS words FROM blocked WHERE words <> '' GROUP BY ALL),
originals AS (SELECT ck, turn, mid, words FROM passages WHERE level = 0 UNION SELECT ck, turn, mid, string_agg(words, ' ' ORDER BY block) FROM passages WHERE level = 0 GROUP BY ck, turn, mid),
linked AS (SELECT q.ck, q.turn, q.mid, q.level, q.block, max(struct_pack(turn := o.turn, mid := o.mid)) FILTER (o.turn IS NOT NULL) AS source FROM passages q LEFT JOIN originals o ON o.ck = q.ck AND o.words = q.words AND o.turn < q.turn WHERE q.level > 0 GROUP BY q.ck, q.turn, q.mid, q.level, q.block),
per AS (SELECT ck, turn, mid, count(*) AS n_quotes, count(source) AS n_linked, arg_min(source, struct_pack(a := level, b := block)) FILTER (source IS NOT NULL) AS parent FROM linked GROUP BY ALL),
path AS (SELECT m.ck, m.turn, m.mid, [struct_pack(turn := m.turn, mid := m.mid)] AS path FROM m LEFT JOIN per USING (ck, turn, mid) WHERE parent IS NULL
  UNION ALL SELECT per.ck, per.turn, per.mid, list_append(path, struct_pack(turn := per.turn, mid := per.mid)) FROM path JOIN per ON per.ck = path.ck AND per.parent.turn = path.turn AND per.parent.mid = path.mid)
SELECT conv_id, given AS turn, role, nullif(path[1].turn, 9223372036854775807) AS thread, row_number() OVER (PARTITION BY m.ck, path[1] ORDER BY path) - 1 AS position, CAST(len(path) - 1 AS BIGINT) AS depth, nullif(parent.turn, 9223372036854775807) AS parent_turn,
       coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, trim(array_to_string([x FOR x IN string_split_regex(text, '\r?\n') IF NOT regexp_matches(x, '{_QUOTE}')], chr(10)), chr(10)) AS text
FROM m JOIN path USING (ck, turn, mid) LEFT JOIN per USING (ck, turn, mid)"""

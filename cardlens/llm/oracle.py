"""DuckDB SQL for the operators that SQL can express."""

_SPACE = r"[\x20\x09-\x0D]+"

OP10 = f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""

_WORD = r"[^\x20\x09-\x0D]+"
_CAPS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPS}', '{_CAPS.lower()}'), '{_WORD}') AS w
           FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM w, unnest(range(1, greatest(1, len(w) - 4) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS whole FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
k AS (SELECT e.a AS doc_id, count(DISTINCT y.whole) AS n_links FROM e JOIN n x ON x.doc_id = e.a JOIN n y ON y.doc_id = e.b
      WHERE x.whole <> y.whole GROUP BY 1),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id,
       CASE WHEN n.n IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY n.whole) END AS class_id,
       coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1) c ON c.doc_id = d.doc_id
"""

# the rules of quality.RULES as plain conditions, in their order
OP6 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '{_WORD}')] AS l FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS c
      FROM w, unnest(range(1, len(w) - 6)) u(i)),
p AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS covers FROM g WHERE c > 1),
r AS (SELECT doc_id, sum(covers) AS n FROM p GROUP BY 1),
f AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, strlen(t) < 2 * length(t) AS short_codes
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             10 * n_symbols > n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines)
             OR word_chars < 2 * n_words OR (word_chars > 20 * n_words AND short_codes) OR 100 * n_upper > 50 * word_chars AS own_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR own_failed) AS kept
FROM j
"""

OP8 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 49], ' ')) < doc_id AS again
      FROM w, unnest(range(1, len(w) - 48)) u(i)),
x AS (SELECT w.doc_id, i, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) u(i)),
k AS (SELECT x.doc_id, x.i, x.word,
             coalesce(bool_or(g.again) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
      FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
             string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""

# crc32 of a text's UTF-8 bytes (code points below 0x800), by the usual table made from its polynomial
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(256) r(i)))"""


def _crc32(text: str) -> str:
    codes = (f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] "
             "ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] END))")
    return (f"xor(list_reduce(list_prepend(4294967295, {codes}), "
            "lambda c, b: xor(c >> 8, crc.tab[(xor(c, b) & 255) + 1])), 4294967295)")


OP11 = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, lang, text, CASE WHEN doc_id IS NULL THEN false ELSE {_crc32("doc_id::VARCHAR")} % 3 = 1 END AS held_out FROM documents, crc),
w AS (SELECT doc_id, lang, held_out, ' ' || w || ' ' AS w, count(*) AS n
      FROM (SELECT doc_id, lang, held_out, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+')) AS w FROM d) GROUP BY ALL),
g AS (SELECT doc_id, lang, held_out, w[i:i + k - 1] AS g, sum(n) AS n
      FROM w, (VALUES (1), (2), (3)) s(k), unnest(range(1, length(w) - k + 2)) u(i) WHERE k > 1 OR (i > 1 AND i < length(w)) GROUP BY ALL),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS r
      FROM g WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, g QUALIFY r < 400),
q AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS r FROM g QUALIFY r < 400),
f AS (SELECT doc_id, l.lang, sum(CASE WHEN p.r IS NULL THEN 400 ELSE abs(p.r - q.r) END) AS far, count(*) AS grams
      FROM q CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.g = q.g GROUP BY ALL),
b AS (SELECT doc_id, lang, 1.0::DOUBLE - far::DOUBLE / (400 * grams)::DOUBLE AS score FROM f
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) = 1)
SELECT d.doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN b ON b.doc_id = d.doc_id
"""


def _op12(rounds: int = 5) -> str:
    far = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT k.vec_id, arg_min(c.c, d * 100 + c.c) AS c, min(d) AS d FROM "
                     f"(SELECT k.vec_id, c.c, {far} AS d FROM kept k CROSS JOIN c{r} c) x JOIN kept k USING (vec_id) JOIN c{r} c USING (c) GROUP BY 1)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT a.c, i, sum(k.v[i])::BIGINT AS s, count(*) AS n "
                         f"FROM a{r} a JOIN kept k USING (vec_id), range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v)::BIGINT[] AS v FROM c{r} c LEFT JOIN m{r} m USING (c))")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < 40),
{", ".join(steps)}
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c
"""


OP12 = _op12()

OP13 = rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_CAPS}', '{_CAPS.lower()}') AS w FROM documents),
r AS (SELECT doc_id, w, count(*) AS n FROM o WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM r, crc),
k AS (SELECT CASE WHEN h % 31 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM h),
v AS MATERIALIZED (SELECT w, sum(n)::BIGINT AS n FROM k WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
i AS MATERIALIZED (SELECT DISTINCT w, w[1:i - 1] || w[i + 1:] AS gap, w[1:i - 1] || '*' || w[i + 1:] AS hole FROM v, unnest(range(1, length(w) + 1)) u(i)),
x AS (SELECT a.w AS a, b.w AS b FROM i a JOIN i b ON a.hole = b.hole AND a.w <> b.w
      UNION SELECT i.w, v.w FROM i JOIN v ON i.gap = v.w UNION SELECT v.w, i.w FROM i JOIN v ON i.gap = v.w),
y AS (SELECT a AS w, b, v.n AS m, count(*) OVER (PARTITION BY a) AS n_near FROM x JOIN v ON v.w = b
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) = 1),
f AS MATERIALIZED (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN b END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n
      FROM v LEFT JOIN y ON y.w = v.w),
t(w, spot, form) AS (SELECT w, w, form FROM f UNION ALL SELECT t.w, f.w, f.form FROM t JOIN f ON f.w = t.form)
SELECT f.w AS word, f.n, f.form, f.form_n, f.n_near, t.spot AS root FROM f JOIN t ON t.w = f.w AND t.form IS NULL
"""

SQL = {"op1_ngram_jaccard_join": OP1, "op6_quality_rules": OP6, "op8_substring_dedup": OP8, "op10_exact_dedup": OP10,
       "op11_language_id": OP11, "op12_centroid_clustering": OP12, "op13_spelling_variants": OP13}

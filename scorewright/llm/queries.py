"""Queries of the training-data operators and, where SQL can express them, DuckDB SQL for the same rows."""

from __future__ import annotations

from scorewright.llm.debruijn import op9_substring_dedup
from scorewright.llm.decontaminate import op1_benchmark_decontamination
from scorewright.llm.hamerly import op13_centroid_clustering
from scorewright.llm.imatch import op4_imatch_fingerprints
from scorewright.llm.impact_search import op12_ranked_lexical_search
from scorewright.llm.langid import op2_language_id
from scorewright.llm.lm_score import op5_lm_scoring
from scorewright.llm.minhash import op10_minhash_near_dedup
from scorewright.llm.posting_lists import op11_nearest_neighbours
from scorewright.llm.sentencepiece_nbest import op6_sentencepiece_nbest
from scorewright.llm.suffix_dedup import op7_suffix_array_dedup
from scorewright.llm.token_rollup import op8_token_counts
from scorewright.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_imatch_fingerprints": op4_imatch_fingerprints,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_sentencepiece_nbest": op6_sentencepiece_nbest,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_centroid_clustering": op13_centroid_clustering,
}

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def _share(a: str, b: str, kind: str, digits: int) -> str:
    names = lambda h: f"list_transform({h}.{kind}, lambda x: left(x, {digits}))"
    either = f"(len({a}.{kind}) + len({b}.{kind}) - len(list_intersect({names(a)}, {names(b)})))"
    return f"(CASE WHEN {either} > 0 THEN len(list_intersect({a}.{kind}, {b}.{kind}))::DOUBLE / {either}::DOUBLE END)"


def _likeness(a: str, b: str) -> str:
    return f"coalesce(({_share(a, b, 'fine', 2)} + {_share(a, b, 'coarse', 1)}) / 2, CASE WHEN {a}.whole = {b}.whole THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def _clusters(k: int, rounds: int, dimensions: int) -> str:
    """Every round written out: assignments a0, a1, ... and centroids c0, c1, ..."""
    names = f"sha256('2:' || vec_id)"
    out = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY {names}) - 1 AS k, x AS c FROM (SELECT * FROM v ORDER BY {names} LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        out.append(f"a{i} AS (SELECT vec_id, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT * {k} + k) AS best FROM v, c{i} GROUP BY vec_id)")
        if i < rounds:
            out.append(f"s{i} AS (SELECT best % {k} AS k, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM (SELECT best, x, unnest(range(1, {dimensions + 1})) AS j FROM a{i}) GROUP BY 1, 2)")
            out.append(f"m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{i} GROUP BY k)")
            out.append(f"c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    out.append(f"o AS (SELECT vec_id, best % {k} AS k, best // {k} AS d FROM a{rounds})")
    return f"WITH {', '.join(out)} SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM o JOIN c{rounds} USING (k)"


SQL = {
    # no masks here: an overlap with so few substitutions has this many pairs of neighbours that are equal
    "op1_benchmark_decontamination": """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ws FROM benchmark),
tp AS (SELECT doc_id, p, ws[p] AS x, CASE WHEN p < len(ws) THEN ws[p + 1] END AS y FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM t)),
bp AS (SELECT item_id, n, p, ws[p] AS x, CASE WHEN p < n THEN ws[p + 1] END AS y FROM (SELECT item_id, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS p FROM b)),
h AS (SELECT doc_id, item_id, tp.p - bp.p AS shift FROM tp JOIN bp ON tp.x = bp.x AND tp.y = bp.y GROUP BY 1, 2, 3, n HAVING count(*) >= CASE WHEN n >= 13 THEN 6 WHEN n >= 9 THEN n - 7 ELSE n - 1 END
  UNION ALL SELECT doc_id, item_id, tp.p - 1 FROM tp JOIN bp ON tp.x = bp.x AND n = 1),
e AS (SELECT h.doc_id, h.item_id, len(b.ws) AS n, least(13, len(b.ws)) AS width,
  list_transform(range(1, len(b.ws) + 1), lambda k: CASE WHEN k + shift >= 1 AND k + shift <= len(t.ws) AND b.ws[k] = t.ws[k + shift] THEN 1 ELSE 0 END) AS same
  FROM h JOIN t USING (doc_id) JOIN b USING (item_id)),
g AS (SELECT doc_id, item_id, n, width, list_sum(same) AS equal, list_max(list_transform(range(1, n - width + 2), lambda k: list_sum(same[k : k + width - 1]))) AS best FROM e)
SELECT doc_id, item_id, max(equal)::BIGINT AS n_equal, max(n)::BIGINT AS n_tokens, max(best)::BIGINT AS best_window FROM g WHERE best >= width - CASE WHEN width >= 9 THEN 3 ELSE 0 END GROUP BY doc_id, item_id
""",
    "op4_imatch_fingerprints": f"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM x),
d AS (SELECT doc_id, n, text, following, left(text, (n - n // 2)::BIGINT) || left(following, (n // 2)::BIGINT) AS edited FROM o),
u AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM x)),
lex AS (SELECT term FROM u GROUP BY term HAVING count(*) >= greatest(2.0, 0.001 * (SELECT count(*) FROM x)) AND count(*) <= 0.2 * (SELECT count(*) FROM x)),
v AS (SELECT doc_id, 1 AS k, text AS body FROM d UNION ALL SELECT doc_id, 2, edited FROM d UNION ALL SELECT doc_id, 3, following FROM d),
w AS (SELECT DISTINCT doc_id, k, term, term IN (SELECT term FROM lex) AS inside FROM (SELECT doc_id, k, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+')) AS term FROM v)),
p AS (SELECT doc_id, k, bool_or(inside) AS has_any FROM w GROUP BY doc_id, k),
m AS (SELECT doc_id, k, left(md5(term), 8) AS g, substr(md5(term), 9, 8) AS h FROM w JOIN p USING (doc_id, k) WHERE inside = has_any),
q AS (SELECT doc_id, k, string_agg(g, ' ' ORDER BY g) AS j FROM m GROUP BY doc_id, k),
y AS (SELECT doc_id, k, left(g, 2) AS n, string_agg(g, '' ORDER BY g) AS r FROM m GROUP BY 1, 2, 3), z AS (SELECT doc_id, k, left(h, 1) AS n, string_agg(h, '' ORDER BY h) AS r FROM m GROUP BY 1, 2, 3),
y2 AS (SELECT doc_id, k, list(n || left(md5(r), 4) ORDER BY n) AS fine FROM y GROUP BY 1, 2), z2 AS (SELECT doc_id, k, list(n || left(md5(r), 4) ORDER BY n) AS coarse FROM z GROUP BY 1, 2),
f AS (SELECT v.doc_id, v.k, left(md5(coalesce(j, '')), 16) AS whole, coalesce(fine, []::VARCHAR[]) AS fine, coalesce(coarse, []::VARCHAR[]) AS coarse FROM v LEFT JOIN q USING (doc_id, k) LEFT JOIN y2 USING (doc_id, k) LEFT JOIN z2 USING (doc_id, k))
SELECT d.doc_id, d.n::BIGINT AS n_chars, sha256(d.edited) AS edited_sha256, a.whole || '.' || array_to_string(a.fine, '') || '.' || array_to_string(a.coarse, '') AS fingerprint, b.whole || '.' || array_to_string(b.fine, '') || '.' || array_to_string(b.coarse, '') AS edited_fingerprint,
  {_likeness("a", "b")} AS near_edited, {_likeness("a", "c")} AS near_next
FROM d JOIN f a ON a.doc_id = d.doc_id AND a.k = 1 JOIN f b ON b.doc_id = d.doc_id AND b.k = 2 JOIN f c ON c.doc_id = d.doc_id AND c.k = 3
""",
    "op5_lm_scoring": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, true AS good FROM labels WHERE quality = 1),
t AS (SELECT doc_id, p, ws[p] AS x, CASE WHEN p = 1 THEN chr(2) ELSE ws[p - 1] END AS y, coalesce(good, false) AS good FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d) LEFT JOIN g USING (doc_id)),
n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (good)::DOUBLE AS g, (count(DISTINCT x) + 1)::DOUBLE AS z FROM t),
c AS (SELECT x, count(*)::DOUBLE AS n, count(*) FILTER (good)::DOUBLE AS g FROM t GROUP BY x),
o AS (SELECT x AS y, n, g FROM c UNION ALL SELECT chr(2), count(*)::DOUBLE, count(*) FILTER (good)::DOUBLE FROM t WHERE p = 1),
q AS (SELECT y, x, count(*)::DOUBLE AS n, count(*) FILTER (good)::DOUBLE AS g FROM t GROUP BY y, x),
l AS (SELECT t.doc_id, -ln((q.g + 2.0::DOUBLE * ((c.g + 1) / (n.g + z))) / (o.g + 2.0::DOUBLE)) AS lt, -ln((q.n + 2.0::DOUBLE * ((c.n + 1) / (n.n + z))) / (o.n + 2.0::DOUBLE)) AS lb
  FROM t JOIN c ON c.x = t.x JOIN o ON o.y = t.y JOIN q ON q.x = t.x AND q.y = t.y, n),
m AS (SELECT doc_id, count(*) AS k, avg(lt) AS lt, avg(lb) AS lb FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_tokens, round(lt, 6) AS target_loss, round(lb, 6) AS background_loss, round(lt - lb, 6) AS difference FROM d LEFT JOIN m USING (doc_id)
""",
    "op7_suffix_array_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, md5(b[p : p + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS p FROM d)),
r AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS fresh FROM r),
s AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS z FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g) GROUP BY doc_id, k),
l AS (SELECT doc_id, count(*) AS n, sum(z - a) AS gone, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS stops FROM s GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  CASE WHEN n IS NULL THEN sha256(b) ELSE sha256(unhex(array_to_string(list_transform(range(1, (n + 2)::BIGINT), lambda i: hex(
    b[CASE WHEN i = 1 THEN 1 ELSE stops[i - 1] END : CASE WHEN i = n + 1 THEN octet_length(b) ELSE starts[i] - 1 END])), ''))) END AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
""",
    "op9_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
w AS (SELECT doc_id, p, md5(array_to_string(ws[p : p + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM d)),
r AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, p + o AS q FROM r, (SELECT unnest(range(0, 35)) AS o)),
l AS (SELECT doc_id, list(q) AS qs FROM c GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: qs IS NULL OR NOT list_contains(qs, i)), lambda i: ws[i]), ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
""",
    "op10_minhash_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[p : p + 3], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.b, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
""",
    "op12_ranked_lexical_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
s AS (SELECT count(*) FILTER (len(ws) > 0) AS nn, sum(len(ws))::BIGINT AS ll FROM d),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, nn),
g AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))) * times)::BIGINT AS score FROM t JOIN q USING (term) JOIN w USING (term), s GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM g WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
""",
    "op13_centroid_clustering": _clusters(40, 5, 64),
}

"""The queries of these operators, and SQL for those that SQL can express.

SQL has none for spans of overlapping rules (op1), greedy balancing (op2), image files (op3), a tokenizer's merges (op5), edit distance
to substrings (op6), online learning (op7) and error-carrying rounding (op8); those are tested against plain versions.
"""

from sparkloom.llm import decontaminate, license_scan, mixing, near_dup, quality, secrets, shard_map, tiff, token_count, url_filter

QUERIES = {
    "op1_secret_spans": secrets.op1_secret_spans,
    "op2_shard_slots": shard_map.op2_shard_slots,
    "op3_tiff": tiff.op3_tiff,
    "op4_url_verdicts": url_filter.op4_url_verdicts,
    "op5_token_counts": token_count.op5_token_counts,
    "op6_benchmark_leaks": decontaminate.op6_benchmark_leaks,
    "op7_quality": quality.op7_quality,
    "op8_mixture": mixing.op8_mixture,
    "op9_license_labels": license_scan.op9_license_labels,
    "op10_near_duplicates": near_dup.op10_near_duplicates,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in url_filter.RULES)
_SIDES = (0, 1)


def _smoothed(k: int) -> str:
    p0 = f"(coalesce(m0.n{k}, 0) + s0.t{k} / {url_filter.SIZE}::DOUBLE) / (s0.s{k} + s0.t{k})"
    p1 = f"(CASE WHEN coalesce(s1.s{k}, 0) >= {url_filter.MIN_CONTEXT} THEN (coalesce(m1.n{k}, 0) + s1.t{k} * {p0}) / (s1.s{k} + s1.t{k}) ELSE {p0} END)"
    return f"(CASE WHEN coalesce(s2.s{k}, 0) >= {url_filter.MIN_CONTEXT} THEN (coalesce(m2.n{k}, 0) + s2.t{k} * {p1}) / (s2.s{k} + s2.t{k}) ELSE {p1} END)"


def _sums(name: str, source: str, by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    return f"{name} AS (SELECT {by + ',' if by else ''} " + ", ".join(f"sum(n{k}) s{k}, count(*) FILTER (WHERE n{k} > 0)::DOUBLE t{k}" for k in _SIDES) + f" FROM {source} {group})"


_URL = f"""WITH u AS (SELECT page_id, url, instr(url, '://') i FROM pages), t AS (SELECT page_id, url, CASE WHEN i > 0 THEN substr(url, i + 3) END r FROM u),
 h AS (SELECT page_id, url, coalesce(translate(regexp_extract(r, '^[^/?#]*'), {_AZ}), '') host, coalesce(regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*'), '') path FROM t),
 rules AS (SELECT * FROM (VALUES {_RULES}) v(verdict, rh, rp)),
 b AS (SELECT h.*, arg_max(rh || rp, length(rh || rp)) FILTER (WHERE rh IS NOT NULL) AS rule, arg_max(r.verdict, length(rh || rp)) FILTER (WHERE rh IS NOT NULL) rv FROM h LEFT JOIN rules r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
 f AS (SELECT *, list_transform(string_split('^^' || translate(translate(coalesce(url, ''), {_AZ}), '0123456789^', '0000000000*') || '^', ''), lambda c: CASE WHEN instr('{url_filter.SYMBOLS}', c) > 0 THEN instr('{url_filter.SYMBOLS}', c) - 1 ELSE 1 END) x FROM b),
 g AS (SELECT page_id, rule IS NOT NULL judged, rv = 'allow' ok, i, x[i] a, x[i + 1] b, x[i + 2] c FROM (SELECT *, unnest(range(1, len(x) - 1)) i FROM f)),
 m2 AS (SELECT a, b, c, {", ".join(f"count(*) FILTER (WHERE ok = {bool(k)}) n{k}" for k in _SIDES)} FROM g WHERE judged GROUP BY ALL), m1 AS (SELECT b, c, {", ".join(f"sum(n{k}) n{k}" for k in _SIDES)} FROM m2 GROUP BY b, c), m0 AS (SELECT c, {", ".join(f"sum(n{k}) n{k}" for k in _SIDES)} FROM m1 GROUP BY c),
 {_sums("s2", "m2", "a, b")}, {_sums("s1", "m1", "b")}, {_sums("s0", "m0", "")},
 d AS (SELECT g.page_id, g.i, coalesce(ln({_smoothed(1)}) - ln({_smoothed(0)}), 0) v FROM g LEFT JOIN m2 ON m2.a = g.a AND m2.b = g.b AND m2.c = g.c LEFT JOIN s2 ON s2.a = g.a AND s2.b = g.b LEFT JOIN m1 ON m1.b = g.b AND m1.c = g.c LEFT JOIN s1 ON s1.b = g.b LEFT JOIN m0 ON m0.c = g.c CROSS JOIN s0),
 sc AS (SELECT page_id, list_reduce(list(v ORDER BY i), lambda p, q: p + q) / count(*) score FROM d GROUP BY page_id),
 j AS (SELECT greatest(least(floor(score / {url_filter.BIN}), {url_filter.BINS}), -{url_filter.BINS}) k, count(*) FILTER (WHERE rv = 'allow') good, count(*) FILTER (WHERE rv = 'block') bad FROM b JOIN sc USING (page_id) WHERE rule IS NOT NULL GROUP BY 1),
 e AS (SELECT k, coalesce(sum(good) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(good) OVER ()::DOUBLE + sum(bad) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(bad) OVER ()::DOUBLE err FROM j),
 lim AS (SELECT CASE WHEN (SELECT min(err) FROM e) < 1 THEN (SELECT k FROM e ORDER BY err, k LIMIT 1) * {url_filter.BIN}::DOUBLE ELSE 0 END lim)
 SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN score >= lim THEN 'allow' ELSE 'block' END) verdict FROM b JOIN sc USING (page_id) CROSS JOIN lim"""

_TEMPLATES = ", ".join(f"({k}, '{t.label}', {t.exact}, {list(t.words)})" for k, t in enumerate(license_scan.TEMPLATES))
_SLACK = license_scan.SLACK

_LICENSE = f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
 tp AS (SELECT * FROM (VALUES {_TEMPLATES}) v(t, label, exact, tok)), tg AS (SELECT *, tok[q + 1] x, tok[q + 2] y, CASE WHEN NOT exact THEN tok[q + 3] END z FROM (SELECT *, unnest(range(0, len(tok) - CASE WHEN exact THEN 1 ELSE 2 END)) q FROM tp)),
 p AS (SELECT doc_id, w, i, w[i + 1] x, w[i + 2] y, w[i + 3] z FROM (SELECT *, unnest(range(0, len(w) - 1)) i FROM w)),
 hit AS (SELECT doc_id, t, label, exact, len(tok) width, q, i - q dg, i - q >= 0 AND w[greatest(i - q + 1, 1):i - q + len(tok)] = tok same,
 len(list_intersect(list_distinct(tok), w[greatest(i - q + 1 - {_SLACK}, 1):greatest(i - q + 1 - {_SLACK}, 1) + len(tok) + {2 * _SLACK} - 1]))::DOUBLE / len(list_distinct(tok)) held FROM p JOIN tg ON p.x = tg.x AND p.y = tg.y AND (tg.z IS NULL OR p.z = tg.z)),
 vt AS (SELECT doc_id, t, label, exact, width, dg, list(DISTINCT q) q, bool_or(same) same, max(held) held FROM hit GROUP BY ALL),
 rn AS (SELECT *, sum(CASE WHEN dg - prev > {_SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, t ORDER BY dg ROWS UNBOUNDED PRECEDING) run FROM (SELECT *, lag(dg) OVER (PARTITION BY doc_id, t ORDER BY dg) prev FROM vt)),
 oc AS (SELECT doc_id, label, exact, len(list_distinct(flatten(list(q))))::DOUBLE / (width - CASE WHEN exact THEN 1 ELSE 2 END) share, max(held) held, count(*) FILTER (WHERE same) n, min(dg) FILTER (WHERE same) lo, max(dg) FILTER (WHERE same) hi FROM rn GROUP BY doc_id, t, label, exact, width, run),
 kd AS (SELECT *, exact AND n > 0 base, NOT exact AND share >= {license_scan.VOTES} AND held >= {license_scan.HELD} near FROM oc),
 ag AS (SELECT doc_id, sum(n) FILTER (WHERE base) n_base, min(lo) FILTER (WHERE base) f, max(hi) FILTER (WHERE base) l, array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base))), ',') bl,
 array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base OR near))), ',') al, max(CASE WHEN base THEN 1.0::DOUBLE WHEN near THEN share ELSE 0 END) score FROM kd GROUP BY doc_id)
 SELECT w.doc_id, len(w)::BIGINT n_words, coalesce(n_base, 0)::BIGINT n_base, f::BIGINT first_word, l::BIGINT last_word, coalesce(bl, '') base_labels, coalesce(al, '') labels, coalesce(score, 0) score FROM w LEFT JOIN ag USING (doc_id)"""

_NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END s FROM w),
 e AS (SELECT doc_id, len(s) n, unnest(s) x FROM s), k AS (SELECT a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM k WHERE 100 * k >= {near_dup.PERCENT} * (na + nb - k)), r AS (SELECT doc_id d, doc_id o FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.o), c AS (SELECT d, min(o) component_id FROM r GROUP BY d)
 SELECT doc_id, len(s)::BIGINT n_shingles, component_id, doc_id = component_id kept FROM s JOIN c ON c.d = s.doc_id"""

SQL: dict[str, str] = {"op4_url_verdicts": _URL, "op9_license_labels": _LICENSE, "op10_near_duplicates": _NEAR}

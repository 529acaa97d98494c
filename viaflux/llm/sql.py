"""DuckDB SQL of the operators that SQL can express over whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


ORACLES: dict[str, str] = {
    "op2_host_quality": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
g AS (SELECT r, i, ws[i:i+7] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d) x),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, win) > 1) y, range(8) z(j) GROUP BY r),
f AS (SELECT d.r, doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c ON d.r = c.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT least(greatest(avg(failed / n), 1e-6), 1 - 1e-6) AS m, var_pop(failed / n) AS v, avg(1 / n) AS inv FROM h),
s AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-9) - 1, 1), 1e6) AS k FROM m),
ok AS (SELECT source, (failed + m * k) / (n + k) <= 0.5 AS host_ok FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_ok, true) AS kept FROM b LEFT JOIN ok ON b.source = ok.source""",
    "op4_decontaminate": f"""
WITH b AS (SELECT item_id, {_PLAIN} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, ws[i:i+k-1] AS win FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0) x),
d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS ws FROM documents),
dw AS (SELECT r, k, i, ws[i:i+k-1] AS win FROM (SELECT r, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) ks) x),
h AS (SELECT r, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hit AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM h JOIN range(10) t(j) ON j < h.k GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) x GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN it ON d.r = it.r""",
    "op6_url_filter": f"""
WITH s AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r AS (SELECT *, CASE WHEN {_fits("example.com", "/en/7")} THEN 'example.com/en/7' WHEN {_fits("example.net", "/de/8")} THEN 'example.net/de/8'
  WHEN {_fits("com", "/en/")} THEN 'com/en/' WHEN {_fits("net", "/de/")} THEN 'net/de/' WHEN {_fits("org", "/es/")} THEN 'org/es/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'example.net/de/8') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, 'casino|free-bets|cheap-pills|spam-farm|adult-x|ads-track') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op7_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i+34], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d) x),
twice AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + j AS p FROM g SEMI JOIN twice USING (win), range(35) t(j)),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS kept FROM w ANTI JOIN gone USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN k ON d.r = k.r""",
}

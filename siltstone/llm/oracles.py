"""DuckDB SQL for the operators that SQL can express; written from the contracts, not from the operators' plans."""

from __future__ import annotations

from siltstone.llm.quality_rules import ALPHA, DELTA, RULES, STEPS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "regexp_extract_all(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+')"


def _scaled(n: str, of: str) -> str:
    return f"CAST(least({STEPS}, floor({float(STEPS)} * {n} / greatest(1, {of}))) AS INT)"


def _only(characters: str) -> str:
    return f"length(regexp_replace(coalesce(text, ''), '[^{characters}]', '', 'g'))"


QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
w AS (SELECT r, doc_id, lang, text, {_WORDS.format("text")} AS w FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM w WHERE len(w) >= 3),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) x WHERE n >= 2),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) x GROUP BY r),
m AS (SELECT w.r, doc_id, lang AS stratum, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({_only("#*$%&|<>")} AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS n_lines, {_only("!")} AS n_bangs, {_only("|")} AS n_pipes, {_only("A-Z")} AS n_capitals
  FROM w LEFT JOIN cov ON cov.r = w.r),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_scaled("n_symbols", "word_chars")} AS symbols, {_scaled("n_dup_lines", "n_lines")} AS dup_lines, {_scaled("n_repeat_words", "n_words")} AS repeats,
  {_scaled("n_bangs", "word_chars")} AS bangs, {_scaled("n_pipes", "word_chars")} AS pipes, {_scaled("n_capitals", "word_chars")} AS capitals FROM m),
mk AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
l AS (SELECT stratum, good, u.rule, u.value FROM s JOIN mk USING (doc_id), LATERAL (SELECT unnest([{", ".join(f"'{r}'" for r in RULES)}]) AS rule, unnest([{", ".join(RULES)}]) AS value) u WHERE NOT base_failed),
b AS (SELECT stratum, rule, value AS cutoff, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE NOT good) AS bad FROM l GROUP BY ALL),
t AS (SELECT stratum, rule, cutoff, coalesce(sum(good) OVER up, 0) AS k, coalesce(sum(bad) OVER up, 0) AS caught, sum(good) OVER (PARTITION BY stratum, rule) AS n, sum(bad) OVER (PARTITION BY stratum, rule) AS n_bad
  FROM b WINDOW up AS (PARTITION BY stratum, rule ORDER BY cutoff DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ns AS (SELECT count(DISTINCT coalesce(stratum, chr(0))) AS strata FROM l),
q AS (SELECT t.*, caught / greatest(1, n_bad) - k / greatest(1, n) AS gain,
  list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA / len(RULES)!r}) + (n - j) * ln(1 - {ALPHA / len(RULES)!r})))) <= {DELTA / len(RULES)!r} / greatest(1, strata) AS allowed FROM t, ns),
c AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) AS rn FROM q WHERE allowed AND caught > 0 AND gain > 0) x WHERE rn = 1),
rej AS (SELECT DISTINCT s.r FROM s JOIN c ON c.stratum IS NOT DISTINCT FROM s.stratum AND CASE c.rule {" ".join(f"WHEN '{r}' THEN {r}" for r in RULES)} END > c.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM rej) AS kept FROM s
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i:i + 49], ' '))) AS gram FROM w WHERE len(w) >= 50),
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (gram) WHERE first < doc_id),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM a ANTI JOIN x USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format("text")}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS rank, (total - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN level >= ratio THEN CAST(cap AS DOUBLE) ELSE min_by(level, rank) FILTER (WHERE level < ratio) OVER () * weight END AS target FROM o),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT *, greatest(0, CAST(round(target - whole * source_size) AS BIGINT)) AS rest FROM p),
x AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.rest, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || d.doc_id), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM x
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, u.b FROM reach JOIN u ON u.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.a = w.doc_id
"""

_ITEM_WORDS = f"regexp_extract_all(translate(coalesce({{0}}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
CONTAMINATION = f"""
WITH b AS (SELECT item_id, {_ITEM_WORDS.format("text")} AS w FROM benchmark), bw AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS gram FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS.format("text")} AS w FROM documents), ms AS (SELECT DISTINCT m FROM bg),
dg AS (SELECT r, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS gram FROM d, ms WHERE len(w) >= m),
h AS (SELECT r, i, m, item_id FROM dg JOIN bg USING (m, gram)),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM h) x GROUP BY r),
q AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""

ORACLES = {
    "op1_quality_rules": QUALITY,
    "op2_substring_dedup": SUBSTRING,
    "op6_mixing": MIXING,
    "op7_minhash_dedup": NEAR,
    "op9_decontamination": CONTAMINATION,
}

"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import mixing

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def op3() -> str:
    # five hex digits are four characters of base 32
    digit = "(('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31"
    return f"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS hex, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), f AS (
  SELECT hex, min(page_id) AS first FROM p GROUP BY hex
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ({digit})::INT, 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (hex)"""


def op4() -> str:
    unit = mixing.UNIT
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({WORDS}), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2e0 * source_size AS cap,
         ([5e0, 2e0, 1e0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         1.5e0 * (SELECT sum(source_size)::BIGINT FROM s) AS whole FROM s
), l AS (
  SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), c AS (
  SELECT arg_min(level, (cap / weight, source)) FILTER (level * weight < cap) AS common FROM l
), t AS (
  SELECT l.source, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, common * weight) END AS target,
         ('0x' || substr(md5(coalesce('0:=' || l.source, '0:null')), 1, 7))::BIGINT * {unit >> 28} AS start FROM l, c
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.start,
         CASE WHEN t.source_size > 0 THEN round(t.target / t.source_size * {unit})::BIGINT ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (((rank + 1) * rate + start) // {unit} - (rank * rate + start) // {unit}))::BIGINT AS taken, source,
       (((rank + 1) * rate + start) // {unit} - (rank * rate + start) // {unit})::BIGINT AS copies
FROM r"""


def op6() -> str:
    space = r"\x20\x09-\x0D"
    soft = ["short_words", "long_words", "repeated_lines", "bullets", "ellipses", "endless_word"]
    fails = {
        "few_words": "n_words < 50",
        "repeated_windows": "100 * n_repeat_words > 50 * n_words",
        "short_words": "10 * word_chars < 22 * n_words",
        "long_words": "word_chars > 14 * n_words",
        "many_symbols": "100 * n_symbols > 10 * n_words",
        "few_letters": "100 * n_letter_words < 60 * n_words",
        "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines",
        "bullets": "n_lines >= 4 AND 100 * n_bullets > 90 * n_lines",
        "ellipses": "n_lines >= 4 AND 100 * n_ellipses > 30 * n_lines",
        "endless_word": "longest > 1000",
    }
    mask = " + ".join(f"CASE WHEN {x} THEN {1 << k} ELSE 0 END" for k, x in enumerate(fails.values()))
    n_soft = " + ".join(f"CASE WHEN {fails[x]} THEN 1 ELSE 0 END" for x in soft)
    hard = " OR ".join(f"({fails[x]})" for x in ("few_words", "repeated_windows", "many_symbols", "few_letters"))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^{space}]+') AS words FROM d
), win AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), often AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM often, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), lines AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line) > 1 AS dup, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^{space}]')
), l AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines,
         count(*) FILTER (starts_with(bare, '- ') OR starts_with(bare, '* ') OR starts_with(bare, '•')) AS n_bullets,
         count(*) FILTER (ends_with(bare, '...') OR ends_with(bare, '…')) AS n_ellipses FROM lines GROUP BY r
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[{space}]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets,
         coalesce(n_ellipses, 0) AS n_ellipses, len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z\x{{C0}}-\x{{10FFFF}}]'))) AS n_letter_words,
         coalesce(list_max(list_transform(words, lambda x: strlen(x))), 0) AS longest
  FROM w LEFT JOIN l USING (r) LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {fails["few_words"]} OR {fails["repeated_windows"]} AS base_failed, NOT ({hard}) AND {n_soft} < 2 AS kept, ({mask})::BIGINT AS failed
FROM m"""


def op9() -> str:
    return r"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u
), rules(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), f AS (
  SELECT r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
         arg_max(verdict, length(rules.host || rules.path)) AS verdict
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (r)"""


def sql() -> dict[str, str]:
    return {"op3_warc_normaliser": op3(), "op4_systematic_mix": op4(), "op6_rule_ledger": op6(), "op9_url_trie": op9()}

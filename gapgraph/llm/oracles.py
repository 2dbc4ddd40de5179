"""DuckDB SQL for the queries that SQL can express over whole tables.

op1 (tokenizer), op6 (fuzzy lines: its self-join of shingles is too slow), op8 (trees) and op10 (edit distance) have
none; tests hold them against brute force.
"""

from __future__ import annotations

from gapgraph.llm import quality_rules as Q
from gapgraph.llm.secret_scan import BASE_RULES, RULES

_WORDS = r"words AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"

_OP2 = f"""
WITH {_WORDS},
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 11, 1))) t(i)),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN least_doc USING (s), range(0, 13) r(j) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS left_text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(left_text, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)"""

_OP3 = rf"""
WITH {_WORDS},
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 6, 1))) t(i)),
often AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win JOIN often USING (doc_id, s), range(0, 8) r(j) GROUP BY doc_id),
base AS (
  SELECT doc_id, source, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id)),
lines AS (SELECT doc_id, coalesce(source, '') AS host, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM words),
hosts AS (SELECT coalesce(source, '') AS host, count(DISTINCT doc_id) AS docs FROM words GROUP BY 1),
boiler AS (SELECT host, line FROM lines JOIN hosts USING (host) WHERE line <> '' GROUP BY host, line, docs HAVING count(DISTINCT doc_id) > {Q.MIN_DOCS} AND count(DISTINCT doc_id) > {Q.MAX_SHARE} * docs),
hit AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM lines JOIN boiler USING (host, line) GROUP BY doc_id),
judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_repeat_words,
    n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT} * n_words AS base_failed, coalesce(n, 0)::BIGINT AS n_boiler_words
  FROM base LEFT JOIN hit USING (doc_id))
SELECT *, NOT base_failed AND n_words - n_boiler_words >= {Q.MIN_WORDS} AND n_words - n_boiler_words >= {Q.MIN_KEPT} * n_words AS kept FROM judged"""

_OP4 = f"""
WITH RECURSIVE {_WORDS},
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE common.n >= 0.8 * (x.n + y.n - common.n) - 1e-9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
classes AS (SELECT a AS doc_id, min(b) AS least_doc FROM reach GROUP BY a),
degrees AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(least_doc, doc_id)) AS class_id, coalesce(degrees.n, 0)::BIGINT AS n_links FROM words LEFT JOIN classes USING (doc_id) LEFT JOIN degrees USING (doc_id)"""


def _spans(order: int) -> str:
    rule = RULES[order]
    pattern = f"((?s:.*?))({rule.pattern})".replace("'", "''")
    value = f"regexp_extract_all(text, '{pattern}', {3 if rule.min_value else 2})"
    return f"""
  SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, stop - length(m) AS start, stop FROM (
    SELECT doc_id, m, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}', 1)) AS g, unnest(regexp_extract_all(text, '{pattern}', 2)) AS m, unnest({value}) AS v,
        generate_subscripts(regexp_extract_all(text, '{pattern}', 1), 1) AS i FROM texts)) WHERE length(v) >= {rule.min_value}"""


_OP5 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(map(_spans, range(len(RULES))))}),
joined AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (ord = {i}) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))},
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < {len(BASE_RULES)}) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN joined USING (doc_id)"""

_OP9 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f"""

#: CRC-32 by its table, made here from the reversed polynomial 0xEDB88320, byte by byte.
_OP7 = """
WITH bits AS (SELECT n, list_reduce(list_concat([n], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) t(n)),
tbl AS (SELECT list(v ORDER BY n) AS t FROM bits),
hexed AS (SELECT doc_id, coalesce(source, '') AS source, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (
  SELECT doc_id, source, (length(h) // 2 + 8)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM hexed, tbl),
keyed AS (SELECT *, md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32) AS k FROM summed),
ranked AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY k, doc_id, size) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source)) AS f FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY f, source, k, doc_id, size) - 1 AS a, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (a * 24 // n)::INTEGER AS shard, (a - ((a * 24 // n) * n + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source FROM placed"""

ORACLES = {
    "op2_de_bruijn_dedup": _OP2,
    "op3_line_frequency_rules": _OP3,
    "op4_lsh_forest_join": _OP4,
    "op5_trigram_secret_scan": _OP5,
    "op7_stratified_shards": _OP7,
    "op9_warc_salvage": _OP9,
}

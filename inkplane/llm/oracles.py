"""DuckDB SQL that computes the registered queries of this subpackage another way."""

from __future__ import annotations

from inkplane.llm import shards



def _zeros(name: str, least: int) -> str:
    return f"lpad({name}, greatest({least}, length({name}))::INT, '0')"


OP2 = f"""
WITH sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    coalesce(CAST(floor(doc_id / {shards.ARRIVAL_IDS}) AS BIGINT)::VARCHAR, 'none' || left(md5(coalesce(text, '')), 4)) AS arrival FROM documents
), placed AS (
  SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY arrival ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seq FROM sized
), named AS (
  SELECT doc_id, n_bytes, seq - min(seq) OVER (PARTITION BY arrival, seq // {shards.ARRIVAL_BYTES}) AS seq, '0001-' || {_zeros("arrival", 8)} || '-' || {_zeros(f"(seq // {shards.ARRIVAL_BYTES})::VARCHAR", 6)} AS shard FROM placed
), shards AS (
  SELECT shard, sum(n_bytes)::BIGINT AS total,
    greatest(floor(ln(greatest(sum(n_bytes), 1) / 4096.0) / ln({shards.FANOUT})), 0)::INTEGER AS tier FROM named GROUP BY shard
), packed AS (
  SELECT *, coalesce(sum(total) OVER (PARTITION BY tier ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM shards WHERE total < {shards.TARGET_BYTES}
), plan AS (
  SELECT *, start // {shards.TARGET_BYTES} AS grp, count(*) OVER g AS parts, start - min(start) OVER g AS inner_start FROM packed WINDOW g AS (PARTITION BY tier, start // {shards.TARGET_BYTES})
), merges AS (
  SELECT shard AS part, '0002-tier' || {_zeros("tier::VARCHAR", 2)} || '-' || {_zeros("grp::VARCHAR", 6)} AS merged, inner_start AS start FROM plan WHERE parts > 1
), final AS (
  SELECT doc_id, n_bytes, coalesce(merged, shard) AS shard, (seq + coalesce(start, 0))::BIGINT AS position
  FROM named LEFT JOIN merges ON part = shard
)
SELECT doc_id, shard, greatest(floor(ln(greatest(sum(n_bytes) OVER (PARTITION BY shard), 1) / 4096.0) / ln({shards.FANOUT})), 0)::INTEGER AS tier,
  position, n_bytes FROM final
"""

OP8 = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS rk FROM base GROUP BY source
), capped AS (
  SELECT *, source_size * 3.0 AS cap, source_size * 3.0 / (rk + 1) AS ratio FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(rk + 1.0) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM capped
), chosen AS (SELECT arg_min(lvl, ratio) AS lvl FROM levels WHERE ratio >= lvl
), targets AS (
  SELECT s.source, s.source_size, s.rk, least((s.rk + 1) * c.lvl, s.cap)::DOUBLE AS target FROM capped s, chosen c
), placed AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, t.rk,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, b.doc_id ROWS UNBOUNDED PRECEDING) - b.size / 2.0::DOUBLE AS middle
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (middle < target)::INT + (middle + source_size < target)::INT + (middle + 2 * source_size < target)::INT END AS copies,
    middle / target AS u FROM placed
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
  round(CASE WHEN copies = 0 THEN NULL WHEN rk = 0 THEN 1.5 - sqrt(2.25 - 2 * u) WHEN rk = 1 THEN u ELSE sqrt(0.25 + 2 * u) - 0.5 END, 9) AS first_position
FROM counted
"""



def _spans(kind: str, order: int, pattern: str, tail: str, least: int) -> str:
    """Spans of a pattern; ``tail`` is what of a match must have ``least`` characters."""
    return f"""
  SELECT doc_id, {order} AS ord, '{kind}' AS kind, start, start + length(m) AS stop FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(len(ms)), lambda i:
      list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i], lambda g: length(g))), 0))) AS start
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM texts WHERE regexp_matches(t, '{pattern}'))
  ) WHERE length(regexp_extract(m, '{tail}', 1)) >= {least}"""


_WORD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_HEAD = _WORD + r"""["'']?\x20*[:=]\x20*["'']?"""
_CHARS = "[A-Za-z0-9+/_.=-]+"
OP1 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (
{_spans("assign", 0, _HEAD + _CHARS, "^" + _HEAD + "(" + _CHARS + ")$", 8)}
UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "^(.*)$", 16)}
UNION ALL {_spans("hex", 2, "[0-9a-f]+", "^(.*)$", 32)}
), listed AS (
  SELECT doc_id, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord) AS spans,
    count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex
  FROM found GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts t LEFT JOIN listed l ON t.doc_id IS NOT DISTINCT FROM l.doc_id
"""

_BREAK = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5 = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BREAK}') AS ws FROM documents
), items AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_BREAK}') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, ws[s:s + 9] AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM items WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT len(win) AS n FROM windows
), spans AS (
  SELECT doc_id, n, s, ws[s:s + n - 1] AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM docs, sizes WHERE len(ws) >= n)
), met AS (SELECT doc_id, item_id, s, n FROM spans JOIN windows USING (win)
), hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS w FROM met) GROUP BY doc_id
), named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""

OP10 = """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT *, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || hex[i])::INTEGER), 4, '0')), lambda a, b: a || b) AS b FROM hashed
), named AS (
  SELECT *, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (list_sum(list_transform(range(0, 5), lambda k: b[5 * i + k + 1]::INTEGER * (1 << (4 - k)))) + 1)::INTEGER, 1)), lambda a, b: a || b) AS payload_digest,
    min(page_id) OVER (PARTITION BY hex) AS least FROM bits
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to FROM named
"""

ORACLES = {"op10_warc": OP10, "op5_winnowing": OP5, "op1_secret_ledger": OP1, "op2_size_tiered_shards": OP2, "op8_curriculum_mix": OP8}

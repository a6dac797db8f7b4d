"""DuckDB SQL of the queries that SQL can express."""

from .mixing import SEED, SHARD_BLOCKS, SHARD_ROWS
from .url_rules import RULES

OP10 = f"""
WITH rows_ AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('|', '{SEED}', doc_id::VARCHAR)) AS draw FROM documents),
dims AS (SELECT source, ceil(count(*) / {SHARD_ROWS}.0)::BIGINT AS shards FROM rows_ GROUP BY source),
sharded AS (SELECT rows_.*, ('0x' || substr(draw, 1, 8))::BIGINT % shards AS shard FROM rows_ JOIN dims USING (source)),
cells AS (SELECT source, shard, sum(size)::BIGINT AS cell_size FROM sharded GROUP BY ALL),
sources AS (SELECT source, sum(cell_size)::BIGINT AS source_size FROM cells GROUP BY ALL),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source) - 1) % 3 + 1)::INT] AS weight,
         3 * source_size AS stop, sum(source_size) OVER () AS all_words FROM sources),
levels AS (
  SELECT *, sum(weight) OVER () AS all_weight,
         sum(stop) OVER w - stop AS stopped_words, sum(weight) OVER w - weight AS stopped_weight FROM weighed
  WINDOW w AS (ORDER BY stop / weight, source ROWS UNBOUNDED PRECEDING)),
stopped AS (SELECT *, (all_words - stopped_words) * weight > stop * (all_weight - stopped_weight) AS is_stopped FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN is_stopped THEN stop::DOUBLE ELSE least(
         (all_words::DOUBLE - coalesce(sum(stop) FILTER (is_stopped) OVER (), 0)::DOUBLE) * weight
         / (sum(CASE WHEN is_stopped THEN 0 ELSE weight END) OVER ())::DOUBLE, stop::DOUBLE) END AS target FROM stopped),
sizes AS (SELECT coalesce(sum(source_size), 0)::BIGINT AS words FROM targets),
blocks AS (SELECT words, greatest(1, words // ({SHARD_BLOCKS} * greatest(1, (SELECT coalesce(sum(shards), 0) FROM dims))))::BIGINT AS block FROM sizes),
q1 AS (SELECT t.*, words // block AS seats, floor(source_size * 3 / block)::BIGINT AS room, block,
              coalesce(target / nullif(sum(target::DECIMAL(38, 3)) OVER ()::DOUBLE, 0), 0) AS share, count(*) OVER () / 2.0::DOUBLE AS half FROM targets t, blocks),
q2 AS (SELECT *, least(floor(share * greatest(0, seats - half) + 0.5)::BIGINT, room) AS sure, floor(share * (seats + half) + 0.5)::BIGINT + 1 AS top FROM q1),
q3 AS (SELECT *, seats - sum(sure) OVER () AS left_ FROM q2),
q4 AS (SELECT *, unnest(range(sure, greatest(sure, top) + 1)) AS k FROM q3),
q5 AS (SELECT *, CASE WHEN k < room AND target > 0 THEN target / (2 * k + 1) END AS quotient FROM q4),
q6 AS (SELECT *, quotient IS NOT NULL AND row_number() OVER (ORDER BY quotient DESC NULLS LAST, source, k) <= left_ AS won FROM q5),
quotas AS (SELECT source, source_size, target, block, (first(sure) + count(*) FILTER (won))::BIGINT AS source_blocks FROM q6 GROUP BY ALL),
c1 AS (SELECT c.*, source_size, target, block, source_blocks AS seats, ceil(cell_size * 3.0::DOUBLE / block)::BIGINT AS room,
              coalesce(cell_size::DOUBLE / nullif(sum(cell_size) OVER (PARTITION BY source)::DOUBLE, 0), 0) AS share,
              count(*) OVER (PARTITION BY source) / 2.0::DOUBLE AS half FROM cells c JOIN quotas USING (source)),
c2 AS (SELECT *, least(floor(share * greatest(0, seats - half) + 0.5)::BIGINT, room) AS sure, floor(share * (seats + half) + 0.5)::BIGINT + 1 AS top FROM c1),
c3 AS (SELECT *, seats - sum(sure) OVER (PARTITION BY source) AS left_ FROM c2),
c4 AS (SELECT *, unnest(range(sure, greatest(sure, top) + 1)) AS k FROM c3),
c5 AS (SELECT *, CASE WHEN k < room AND cell_size > 0 THEN cell_size::DOUBLE / (2 * k + 1) END AS quotient FROM c4),
c6 AS (SELECT *, quotient IS NOT NULL AND row_number() OVER (PARTITION BY source ORDER BY quotient DESC NULLS LAST, shard, k) <= left_ AS won FROM c5),
dealt AS (SELECT source, shard, cell_size, source_size, target, least((first(sure) + count(*) FILTER (won)) * block, cell_size * 3)::BIGINT AS cell_words
          FROM c6 GROUP BY source, shard, cell_size, source_size, target, block),
streams AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY draw, size ROWS UNBOUNDED PRECEDING) - size AS before_ FROM sharded)
SELECT doc_id, size, source_size, target,
       CASE WHEN cell_size = 0 THEN 0 ELSE cell_words // cell_size * size
            + greatest(0, least(size, cell_words - cell_words // cell_size * cell_size - before_)) END::BIGINT AS taken
FROM streams JOIN dealt USING (source, shard)
"""

_B32 = "list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr({hex}, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)), 'string_agg', '')"

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes, {_B32.format(hex="hex")} AS payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to FROM m
"""

def _fits(verdict: str) -> str:
    """One expression for all pattern rules of a verdict."""
    return "|".join(r.pattern for r in RULES if not r.site and r.verdict == verdict).replace("'", "''")


OP7 = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
r AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM u),
h AS (SELECT page_id, regexp_extract(rest, '^[^/]*') AS raw, rest FROM r),
s AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS path FROM h),
f AS (SELECT *, translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(low, '{_fits("allow")}') THEN 'allow'
    WHEN regexp_matches(low, '{_fits("block")}') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""

OP4 = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
esc AS (SELECT *,
    CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|') THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END AS shown FROM src)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(shown) + 12 + 1 + 10 + 1)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""

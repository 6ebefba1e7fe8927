"""DuckDB SQL for the queries of this package that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"

OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, {WORDS} AS ws FROM documents
), w AS (
  SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM d
), g AS (
  SELECT rid, i, a || ' ' || lead(a, 1) OVER p || ' ' || lead(a, 2) OVER p AS win FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g WHERE win IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \t\n\x0b\f\r]') GROUP BY rid
), m AS (
  SELECT d.doc_id, d.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.dup, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
  FROM d LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)
), f AS (
  SELECT *, n_words < 50 AS r1, 100 * n_repeat_words > 50 * n_words AS r2, n_symbols > 0.5::DOUBLE * n_words AS r3, n_dup_lines > 0.6::DOUBLE * n_lines AS r4 FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(r1::INT)::DOUBLE AS f1, sum(r2::INT)::DOUBLE AS f2, sum(r3::INT)::DOUBLE AS f3, sum(r4::INT)::DOUBLE AS f4 FROM f GROUP BY source
), long AS (
  SELECT source, n, r, x FROM (SELECT source, n, unnest([1, 2, 3, 4]) AS r, unnest([f1, f2, f3, f4]) AS x FROM h)
), mean AS (
  SELECT r, sum(x) / sum(n) AS m, sum(x * x / n) / sum(n) AS m2 FROM long GROUP BY r
), prior AS (
  SELECT r, m, greatest(1.0, m * (1 - m) / greatest(m2 - m * m, 1e-9) - 1) AS weight FROM mean
), shrunk AS (
  SELECT source, r, (x + m * weight) / (n + weight) AS rate FROM long JOIN prior USING (r)
), verdict AS (
  SELECT source, bool_or(rate > 0.6) AS bad, {", ".join(f"max(rate) FILTER (r = {i}) AS rate{i}" for i in range(1, 5))} FROM shrunk GROUP BY source
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (r1 OR r2) AS base_failed, NOT (r1 OR r2) AND NOT verdict.bad AS kept,
  verdict.bad AS host_failed, round(rate1, 9) AS host_rate_short, round(rate2, 9) AS host_rate_repeats, round(rate3, 9) AS host_rate_symbols, round(rate4, 9) AS host_rate_dup_lines
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""

OP8 = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents
), s AS (
  SELECT rid, doc_id, h, bytes, 0 AS depth, sum(bytes) OVER () AS b, count(*) OVER () AS n FROM d
  UNION ALL
  SELECT rid, doc_id, h, bytes, depth + 1, sum(bytes) OVER (PARTITION BY h >> (59 - depth)), count(*) OVER (PARTITION BY h >> (59 - depth))
  FROM s WHERE b > 2097152 AND n > 1 AND depth < 60
)
SELECT doc_id, CASE WHEN depth = 0 THEN 'root' ELSE substr(lpad(bin(h), 60, '0'), 1, depth) END AS shard, bytes FROM s WHERE b <= 2097152 OR n = 1
"""

OP10 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len({WORDS})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents
), s AS (
  SELECT source, source_size, 3 * source_size AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS no
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lev
  FROM s WINDOW p AS (ORDER BY cap::DOUBLE / w, no)
), t AS (
  SELECT source, no, source_size, least(cap::DOUBLE, max(lev) OVER () * w) AS target, least(cap, floor(least(cap::DOUBLE, max(lev) OVER () * w) + 0.5)::BIGINT) AS want FROM l
), q AS (
  SELECT *, (source_size + 255) // 256 AS blocks, CASE WHEN source_size = 0 THEN 0 ELSE (want // source_size) * ((source_size + 255) // 256) + (want % source_size + 255) // 256 END::BIGINT AS need FROM t
), share AS (
  SELECT *, floor((c - need)::DOUBLE / total::DOUBLE * 2147483648)::BIGINT AS lo, floor(c::DOUBLE / total::DOUBLE * 2147483648)::BIGINT AS hi
  FROM (SELECT *, sum(need) OVER (ORDER BY no) AS c, sum(need) OVER () AS total FROM q WHERE need > 0)
), point AS (
  SELECT slot, (slot % 2147483648) * 1327217885 % 2147483648 AS p FROM (SELECT unnest(range((SELECT coalesce(sum(need), 0)::BIGINT FROM q))) AS slot)
), ranked AS (
  SELECT slot, no, need, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS rank FROM point JOIN share ON p >= lo AND p < hi
), free AS (
  SELECT slot, row_number() OVER (ORDER BY slot) AS k FROM ranked WHERE rank >= need
), short AS (
  SELECT no, rank, row_number() OVER (ORDER BY rank, no) AS k
  FROM (SELECT no, unnest(range(coalesce(got, 0), need)) AS rank FROM share LEFT JOIN (SELECT no, count(*) AS got FROM ranked GROUP BY no) USING (no))
), mix AS (
  SELECT slot, no, rank FROM ranked WHERE rank < need UNION ALL SELECT slot, no, rank FROM free JOIN short USING (k)
), blocks AS (
  SELECT slot, no, rank % blocks AS block, least(256, source_size - rank % blocks * 256, want - rank // blocks * source_size - rank % blocks * 256) AS words FROM mix JOIN q USING (no)
), r AS (
  SELECT rid, source, size, (sum(size) OVER (PARTITION BY source ORDER BY place, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d
), parts AS (
  SELECT rid, no, start, size, unnest(range(start // 256, (start + size - 1) // 256 + 1)) AS block FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source WHERE size > 0
), given AS (
  SELECT rid, slot, least(start + size, block * 256 + words) - greatest(start, block * 256) AS part FROM parts JOIN blocks USING (no, block)
), sums AS (
  SELECT rid, sum(part)::BIGINT AS taken, min(slot)::BIGINT AS slot, count(*) AS n_slots FROM given WHERE part > 0 GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, slot, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN sums USING (rid)
"""

#: CRC-32 of conv_id's digits, bit by bit.
CRC = "xor(list_reduce(flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(substr(s, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295::BIGINT), 4294967295)"

OP11 = rf"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS r,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS e, len({WORDS})::BIGINT AS n
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC} % 4 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, r, e, n FROM c JOIN t ON t.conv_id = base AND r < h
  UNION ALL SELECT c.conv_id, 1 AS own, r, e, n FROM c JOIN t ON t.conv_id = c.conv_id AND r >= h
), path AS (
  SELECT conv_id, row_number() OVER p AS depth, sha256(string_agg(e, '') OVER p) AS k, n, count(*) OVER (PARTITION BY conv_id) AS turns FROM rebuilt WINDOW p AS (PARTITION BY conv_id ORDER BY own, r)
  UNION ALL SELECT c.conv_id, 0, '', 0, (SELECT count(*) FROM rebuilt WHERE rebuilt.conv_id = c.conv_id) FROM c
), stepped AS (
  SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM path
), node AS (
  SELECT depth, k, min(up) AS up, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, min(n) AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = turns), '')) AS ends_sha256
  FROM stepped GROUP BY depth, k
), child AS (
  SELECT depth - 1 AS depth, up AS k, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL
), named AS (
  SELECT node.*, coalesce(child.n, 0)::BIGINT AS n_children FROM node LEFT JOIN child USING (depth, k)
), below AS (
  SELECT path.depth, path.k, count(*) FILTER (n_children = 0)::BIGINT AS n_leaves, sum((n_convs - 1) * named.n)::BIGINT AS saved_tokens
  FROM named JOIN path ON path.conv_id = named.conv_id AND path.depth <= named.depth GROUP BY ALL
)
SELECT named.conv_id, named.depth, parent.conv_id AS parent_conv_id, named.n_convs, named.n_children, n_leaves, saved_tokens, named.ends_sha256
FROM named JOIN below USING (depth, k) LEFT JOIN node AS parent ON parent.depth = named.depth - 1 AND parent.k = named.up
"""

SQL = {"op5_host_quality": OP5, "op8_extendible_sharding": OP8, "op10_mixing": OP10, "op11_prefix_trie": OP11}

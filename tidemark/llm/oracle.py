"""SQL for the queries that SQL can express, over whole tables.

op1, op2, op4 to op7, op9 and op10 rest on learned weights, hashes or tokenizers that SQL does not have;
tests/llm holds them against brute force.
"""

WORD = r"[^\x20\x09-\x0D]+"
DIVISORS = 64


def largest_quotients(parties: str, group: str, key: str, weight: str, seats: str) -> str:
    """Seats by highest quotients weight / (2 s + 1), straight from the definition: every party offers
    as many quotients as it could get at most, and the highest of the group are given."""
    return f"""
    SELECT {group} AS g, {key} AS k, count(*) AS got FROM (
      SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY q DESC, {key}) AS place FROM (
        SELECT p.*, p.{weight} / (2 * s + 1) AS q
        FROM (SELECT *, {weight} / sum({weight}) OVER (PARTITION BY {group}) AS part, count(*) OVER (PARTITION BY {group}) AS n FROM {parties} WHERE {weight} > 0) p,
             generate_series(0, CAST(ceil(p.part * p.{seats}) AS BIGINT) + p.n) t(s)))
    WHERE place <= {seats} GROUP BY ALL"""


OP3 = f"""
WITH sizes AS MATERIALIZED (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, CASE WHEN doc_id IS NULL THEN md5(text) END AS digest FROM documents),
by_source AS MATERIALIZED (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sizes GROUP BY source),
caps AS (SELECT *, [3.0, 1.0, 2.0][(no - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(source_size) FROM by_source) AS total FROM by_source),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
held AS (SELECT arg_min(level, (cap / w, no)) FILTER (WHERE level <= cap / w) AS level FROM levels),
targets AS MATERIALIZED (
  SELECT c.source, c.no, c.source_size, c.docs, coalesce(least(c.cap, h.level * c.w), c.cap) AS target, 1 AS one FROM caps c, held h),
filled AS MATERIALIZED (SELECT *, source_size // {DIVISORS} AS n_full, target >= 2 * source_size OR source_size < {DIVISORS} AS own FROM targets),
sharing AS MATERIALIZED (
  SELECT no, target, one, greatest(0, CAST(round(((SELECT max(total) FROM caps) - (SELECT coalesce(sum(target), 0) FROM filled WHERE own)) / {DIVISORS}) AS BIGINT)) AS house FROM filled WHERE NOT own),
won AS MATERIALIZED ({largest_quotients("sharing", "one", "no", "target", "house")}),
bought AS (SELECT f.*, least(coalesce(w.got, 0) * {DIVISORS}, 2 * source_size) AS words FROM filled f LEFT JOIN won w ON w.k = f.no),
timed AS (SELECT *, CAST(CASE WHEN own THEN floor(target / greatest(1, source_size) + 0.5) ELSE words // greatest(1, source_size) END AS BIGINT) AS times FROM bought),
quotas AS MATERIALIZED (
  SELECT *, CASE WHEN own THEN 0 ELSE least(n_full, CAST(floor((words - times * source_size) / {DIVISORS} + 0.5) AS BIGINT)) END AS rest FROM timed),
inside AS MATERIALIZED (
  SELECT *, sum(size) OVER (PARTITION BY no, shard ORDER BY doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM (
    SELECT s.doc_id, s.size, t.no, t.source_size, t.target,
      CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), s.digest, '')), 1, 8) AS BIGINT) % least({1 << 16}, CAST(ceil(t.docs / 2048) AS BIGINT)) AS shard
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)),
laid AS (SELECT no, shard, max(upto) AS words, coalesce(sum(max(upto)) OVER (PARTITION BY no ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM inside GROUP BY no, shard),
shards AS MATERIALIZED (
  SELECT l.no, l.shard, l.start, q.times, q.rest, least(q.n_full, CAST(ceil(l.start / {DIVISORS}) AS BIGINT)) AS first,
    least(q.n_full, CAST(ceil((l.start + l.words) / {DIVISORS}) AS BIGINT)) - least(q.n_full, CAST(ceil(l.start / {DIVISORS}) AS BIGINT)) AS n FROM laid l JOIN quotas q ON q.no = l.no),
shares AS MATERIALIZED ({largest_quotients("shards", "no", "shard", "n", "rest")}),
placed AS MATERIALIZED (SELECT i.doc_id, i.size, i.no, i.source_size, i.target, i.upto + s.start AS upto FROM inside i JOIN shards s ON s.no = i.no AND s.shard = i.shard),
drawn AS (
  SELECT s.no, s.shard, b.block, s.times, coalesce(h.got, 0) AS got, row_number() OVER (PARTITION BY s.no, s.shard ORDER BY md5('42:' || s.no || ':' || s.shard || ':' || b.block), b.block) AS place
  FROM shards s LEFT JOIN shares h ON h.g = s.no AND h.k = s.shard, generate_series(s.first, s.first + s.n - 1) b(block) WHERE s.n > 0),
blocks AS MATERIALIZED (
  SELECT no, block, times + CASE WHEN place <= got THEN 1 ELSE 0 END AS times FROM drawn
  UNION ALL SELECT no, n_full, times FROM quotas WHERE source_size > n_full * {DIVISORS}),
covered AS (
  SELECT p.doc_id, p.no, p.upto, p.size, sum(times * (least((block + 1) * {DIVISORS}, p.upto) - greatest(block * {DIVISORS}, p.upto - p.size))) AS taken
  FROM placed p JOIN blocks b ON b.no = p.no AND (b.block + 1) * {DIVISORS} > p.upto - p.size AND b.block * {DIVISORS} < p.upto WHERE p.size > 0 GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(c.taken, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN covered c ON c.doc_id IS NOT DISTINCT FROM p.doc_id AND c.no = p.no AND c.upto = p.upto AND c.size = p.size
"""

OP8 = """
WITH keyed AS (SELECT *, CASE WHEN conv_id IS NULL THEN 'row ' || row_number() OVER () ELSE 'id ' || conv_id END AS c FROM conversations),
placed AS MATERIALIZED (
  SELECT c, conv_id, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
    coalesce(role, '') AS role, coalesce(text, '') AS text,
    md5(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')) AS h
  FROM keyed),
prefixes AS MATERIALIZED (
  SELECT c, conv_id, n, count(*) OVER (PARTITION BY c) AS total, md5(string_agg(h, '') OVER (PARTITION BY c ORDER BY n ROWS UNBOUNDED PRECEDING)) AS name FROM placed),
whole AS (SELECT arg_min(c, (conv_id IS NULL, conv_id, c)) AS c, min(conv_id) AS conv_id, n AS n_turns, count(*) AS copies, name FROM prefixes WHERE n = total GROUP BY n, name),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.n < p.total AND p.n = w.n_turns AND p.name = w.name))
SELECT k.conv_id, k.n_turns, k.copies, string_agg('<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10), '' ORDER BY p.n) AS text
FROM kept k JOIN placed p ON p.c = k.c GROUP BY k.c, k.conv_id, k.n_turns, k.copies
"""

ORACLE_SQL: dict[str, str] = {"op3_sainte_lague_mix": OP3, "op8_chat_snapshots": OP8}

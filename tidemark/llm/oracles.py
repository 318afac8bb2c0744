"""DuckDB SQL of the queries that SQL can express."""

OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
n AS (SELECT source AS s, greatest(1, (sum(size) + 999999) // 1000000, (count(*) + 1999) // 2000)::BIGINT AS shards FROM sized GROUP BY source),
dealt AS (SELECT sized.*, ('0x' || substr(place, 1, 8))::BIGINT % shards AS shard FROM sized JOIN n ON source IS NOT DISTINCT FROM s),
by_unit AS (SELECT source, shard, sum(size)::BIGINT AS words FROM dealt GROUP BY ALL),
by_source AS (SELECT source, sum(words)::BIGINT AS source_size FROM by_unit GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS idx FROM by_source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(idx % 3 + 1)::INT]::DOUBLE AS weight, 3 * source_size::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, ((sum(source_size::DOUBLE) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
units AS (
  SELECT u.source, u.shard, u.words, t.source_size, t.target,
         CASE WHEN u.words > 0 THEN t.target * u.words / t.source_size * ceil(u.words / 32)::BIGINT * 32 / u.words ELSE 0 END AS votes
  FROM by_unit u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source),
near AS (
  SELECT source, shard, votes, ceil(words / 32)::BIGINT AS blocks,
         greatest(1, round(sum(votes) OVER () / 32))::BIGINT AS seats,
         (ceil(count(*) OVER () * votes / sum(votes) OVER ()) + 2)::BIGINT AS slack
  FROM units WHERE votes > 0),
sures AS (SELECT *, greatest(0, least(floor(votes / 32)::BIGINT - slack, 3 * blocks)) AS sure FROM near),
opens AS (SELECT *, seats - sum(sure) OVER () AS open, least(sure + 2 * slack + 1, 3 * blocks) AS top FROM sures),
rivals AS (SELECT source, shard, open, votes, unnest(range(sure::BIGINT, top::BIGINT)) AS k FROM opens),
places AS (SELECT *, row_number() OVER (ORDER BY votes / (2 * k + 1) DESC, source ASC NULLS LAST, shard, k) AS place FROM rivals),
won AS (SELECT source, shard, count(*) AS won FROM places WHERE place <= open GROUP BY ALL),
quotas AS (
  SELECT o.source, o.shard, o.blocks, o.sure + coalesce(w.won, 0) AS quota
  FROM opens o LEFT JOIN won w ON o.source IS NOT DISTINCT FROM w.source AND o.shard = w.shard),
plan AS (
  SELECT u.source, u.shard, u.source_size, u.target, coalesce(q.blocks, 1) AS blocks, coalesce(q.quota, 0) AS quota,
         ('0x' || substr(md5('17:' || coalesce(u.source, '') || ':' || u.shard::VARCHAR), 1, 8))::BIGINT % coalesce(q.blocks, 1) AS first
  FROM units u LEFT JOIN quotas q ON u.source IS NOT DISTINCT FROM q.source AND u.shard = q.shard),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM dealt)
SELECT d.doc_id, d.size, p.source_size, round(p.target, 6) AS target,
       ((p.quota // p.blocks) * d.size
        + greatest(0, least(d.a + d.size, (p.first + p.quota % p.blocks) * 32) - greatest(d.a, p.first * 32))
        + greatest(0, least(d.a + d.size, (p.first + p.quota % p.blocks - p.blocks) * 32) - greatest(d.a, 0)))::BIGINT AS taken
FROM placed d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source AND d.shard = p.shard
"""

OP4 = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
wins AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice
  FROM (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k+4], chr(31)))) AS win FROM w WHERE len(words) >= 5)),
spots AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM wins WHERE twice),
reps AS (SELECT doc_id, count(*) AS n FROM spots GROUP BY ALL),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL),
lens AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL),
f AS (
  SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, coalesce(lens.n, 0) AS n_lines,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN reps ON w.doc_id = reps.doc_id LEFT JOIN dups ON w.doc_id = dups.doc_id LEFT JOIN lens ON w.doc_id = lens.doc_id),
raw AS (
  SELECT doc_id, lang, source, n_words, m.i AS metric, m.v AS v
  FROM (SELECT *, greatest(n_words, 1) AS n FROM f) f, LATERAL (SELECT unnest([
    {'i': 0, 'v': 1000 * word_chars // n}, {'i': 1, 'v': 10000 * greatest(n_symbols - 1, 0) // n},
    {'i': 2, 'v': 10000 * greatest(n_dup_lines - 1, 0) // greatest(n_lines, 1)}, {'i': 3, 'v': 10000 * greatest(n_repeat_words - 1, 0) // n}]) AS m)),
v AS (SELECT doc_id, lang, source, n_words, metric, (v >> greatest(0, length(ltrim(bin(v), '0')) - 8)) << greatest(0, length(ltrim(bin(v), '0')) - 8) AS v FROM raw),
b AS (SELECT lang, source, metric, v AS bucket, count(*) AS n, [90, 90, 98, 98][metric + 1] AS tail FROM v WHERE n_words > 0 GROUP BY ALL),
by_source AS (
  SELECT lang, source, metric, any_value(docs) AS docs, min(bucket) FILTER (100 * upto >= (100 - tail) * docs) AS low, min(bucket) FILTER (2 * upto >= docs) AS mid, min(bucket) FILTER (100 * upto >= tail * docs) AS high
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric) AS docs, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto FROM b) GROUP BY ALL),
by_lang AS (
  SELECT lang, metric, any_value(docs) AS docs, min(bucket) FILTER (100 * upto >= (100 - tail) * docs) AS low, min(bucket) FILTER (2 * upto >= docs) AS mid, min(bucket) FILTER (100 * upto >= tail * docs) AS high
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, metric) AS docs, sum(n) OVER (PARTITION BY lang, metric ORDER BY bucket) AS upto
        FROM (SELECT lang, metric, tail, bucket, sum(n) AS n FROM b GROUP BY ALL)) GROUP BY ALL),
by_all AS (
  SELECT metric, min(bucket) FILTER (100 * upto >= (100 - tail) * docs) AS low, min(bucket) FILTER (2 * upto >= docs) AS mid, min(bucket) FILTER (100 * upto >= tail * docs) AS high
  FROM (SELECT *, sum(n) OVER (PARTITION BY metric) AS docs, sum(n) OVER (PARTITION BY metric ORDER BY bucket) AS upto
        FROM (SELECT metric, tail, bucket, sum(n) AS n FROM b GROUP BY ALL)) GROUP BY ALL),
lim AS (
  SELECT s.lang, s.source, s.metric, CASE WHEN s.docs >= 100 THEN s.mid WHEN l.docs >= 100 THEN l.mid ELSE a.mid END AS mid,
         CASE WHEN s.docs >= 100 AND s.mid > s.low THEN s.mid - s.low WHEN l.docs >= 100 AND l.mid > l.low THEN l.mid - l.low ELSE a.mid - a.low END AS below,
         CASE WHEN s.docs >= 100 AND s.high > s.mid THEN s.high - s.mid WHEN l.docs >= 100 AND l.high > l.mid THEN l.high - l.mid ELSE a.high - a.mid END AS above
  FROM by_source s JOIN by_lang l ON s.lang IS NOT DISTINCT FROM l.lang AND s.metric = l.metric JOIN by_all a ON s.metric = a.metric),
ok AS (
  SELECT v.doc_id, bool_and(v.v <= mid + 3 * above AND (v.metric > 0 OR v.v >= mid - 3 * below)) AS ok
  FROM v JOIN lim ON v.lang IS NOT DISTINCT FROM lim.lang AND v.source IS NOT DISTINCT FROM lim.source AND v.metric = lim.metric GROUP BY ALL)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(ok, false) AS kept
FROM f LEFT JOIN ok USING (doc_id)
"""

OP6 = r"""
WITH lines AS (
  SELECT doc_id, i, l, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l) - 1 AS at
  FROM (SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)),
toks AS (
  SELECT doc_id, i, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS w
  FROM (SELECT doc_id, i, regexp_extract_all(l, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS w FROM lines)),
numbered AS (
  SELECT *, coalesce(sum(CASE WHEN regexp_matches(w, '[.!?,;:]["'')\]]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM toks),
units AS (
  SELECT doc_id, i, u, string_agg(w, '' ORDER BY k) AS tile, lower(string_agg(regexp_replace(w, '^[\x20\x09-\x0D]+', ''), ' ' ORDER BY k)) AS norm, count(*) AS words FROM numbered GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, u) AS j, sum(length(tile)) OVER (PARTITION BY doc_id, i ORDER BY u) AS upto,
         lead(u) OVER (PARTITION BY doc_id, i ORDER BY u) IS NULL AS last FROM units),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, j) > 1 AS later FROM placed),
runs AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id, later ORDER BY j) AS run FROM ranked),
judged AS (SELECT *, later AND sum(words) OVER (PARTITION BY doc_id, later, run) >= 40 AS gone FROM runs),
spans AS (
  SELECT j.doc_id, j.i, j.j, j.u, gone, "at" + upto - length(tile) AS a, CASE WHEN last THEN "at" + length(l) ELSE "at" + upto END AS b, l, "at" FROM judged j JOIN lines n ON j.doc_id = n.doc_id AND j.i = n.i),
left_lines AS (
  SELECT n.doc_id, n.i, CASE WHEN any_value(s.u) IS NULL THEN n.l ELSE string_agg(substr(n.l, (s.a - n.at + 1)::BIGINT, (s.b - s.a)::BIGINT), '' ORDER BY s.u) FILTER (NOT s.gone) END AS l
  FROM lines n LEFT JOIN spans s ON n.doc_id = s.doc_id AND n.i = s.i GROUP BY n.doc_id, n.i, n.l),
texts AS (SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i), '') AS text FROM left_lines GROUP BY doc_id),
counts AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, string_agg(a::BIGINT::VARCHAR || ':' || b::BIGINT::VARCHAR, ',' ORDER BY j) FILTER (gone) AS removed FROM spans GROUP BY doc_id)
SELECT t.doc_id, text, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed FROM texts t LEFT JOIN counts USING (doc_id)
"""

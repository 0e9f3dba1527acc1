"""DuckDB SQL of the operators that SQL can express."""

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUP = rf"""
WITH RECURSIVE
t AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM t),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, c.m AS component_id, s.doc_id = c.m AS kept
FROM s JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = s.doc_id
"""

_ITEM_WORDS = rf"regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAM = rf"""
WITH
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
      FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
o AS (SELECT d.doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
      FROM d, (SELECT DISTINCT m FROM p) q, unnest(range(1, len(w) - m + 2)) AS u(i)),
h AS (SELECT o.doc_id, o.i, o.m, p.item_id FROM o JOIN p ON o.g = p.g AND o.m = p.m),
c AS (SELECT doc_id, count(DISTINCT k) AS n FROM h, unnest(range(h.i, h.i + h.m)) AS u(k) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""




SHARDING = rf"""
WITH
t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n::BIGINT], list_transform(range(0, 8), lambda z: 0::BIGINT)),
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x, md5(coalesce(doc_id::VARCHAR, '')) AS m FROM documents),
k AS (SELECT doc_id, n, ('0x' || m[1:7])::BIGINT AS k1, ('0x' || m[8:14])::BIGINT AS k2,
        xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, n), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
            lambda a, b: xor(a >> 8, t.crc[xor(a & 255, b) + 1])), 4294967295) AS crc
      FROM d, t),
s0 AS (SELECT doc_id, n, k1, k2, crc, unnest(range(1, 42)) AS s FROM k),
s1 AS (SELECT *, (((k1 + s * 1640531527) % 2147483647) * 48271 + k2) % 2147483647 AS a FROM s0),
s2 AS (SELECT *, (xor(a, a >> 15) * 69621 + k1) % 2147483647 AS b FROM s1),
s3 AS (SELECT *, (xor(b, b >> 13) * 39373 + k2) % 2147483647 AS c FROM s2),
s4 AS (SELECT *, (xor(c, c >> 16) * 48271 + k1) % 2147483647 AS v FROM s3),
g AS (SELECT doc_id, n, k1, crc, max((v, -s)) FILTER (WHERE s <= 40) AS p, max((v, -s)) AS q FROM s4 GROUP BY doc_id, n, k1, crc),
z AS (SELECT doc_id, n, crc, k1, (-p[2] - 1)::INTEGER AS shard, (-q[2] - 1)::INTEGER AS grown_shard, (SELECT count(*) // (40 * 20000) + 1 FROM documents) AS buckets FROM g)
SELECT doc_id, (n + 16)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY k1 % buckets, doc_id, crc, n) - 1 AS slot, grown_shard
FROM z
"""

TOP_K = """
WITH
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, coalesce(score, 0) AS score FROM r WHERE rank <= 20
"""

_URL = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {0})"
_RULES = [("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), ("example.org/es/", "block"), ("example.org/en/1", "block")]


def _rule_case() -> str:
    parts = []
    for rule, _ in sorted(_RULES, key=lambda r: -len(r[0])):
        host, _, rest = rule.partition("/")
        parts.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}') THEN '{rule}'")
    return f"CASE {' '.join(parts)} END"


def _levels() -> str:
    """Witten-Bell mixtures from one character without context to four of context."""
    out = []
    for d in range(5):
        out.append(f"c{d} AS (SELECT right(gram, {d + 1}) AS gram, sum(a) AS a, sum(b) AS b FROM g GROUP BY 1)")
        out.append(f"x{d} AS (SELECT left(gram, {d}) AS ctx, sum(a) AS xa, sum(b) AS xb, count(*) FILTER (WHERE a > 0) AS ta, count(*) FILTER (WHERE b > 0) AS tb FROM c{d} GROUP BY 1)")
        below = "(SELECT 1.0::DOUBLE / ((SELECT count(*) FROM c0) + 1) AS qa, 1.0::DOUBLE / ((SELECT count(*) FROM c0) + 1) AS qb)" if d == 0 else f"p{d - 1}"
        on = "ON true" if d == 0 else f"ON p.gram = right(c.gram, {d})"
        mix = ", ".join(f"CASE WHEN x{y} > 0 THEN ({y}::DOUBLE + t{y} * q{y}) / (x{y} + t{y})::DOUBLE ELSE q{y} END AS q{y}" for y in "ab")
        out.append(f"p{d} AS (SELECT c.gram, {mix} FROM c{d} c JOIN x{d} x ON x.ctx = left(c.gram, {d}) JOIN {below} p {on})")
    return ",\n".join(out)


URL_FILTER = rf"""
WITH
u AS (SELECT page_id, coalesce(url, '') AS url, {LOWER.format(_URL.format(1))} AS host, {_URL.format(2)} AS path, row_number() OVER () AS r FROM pages),
w AS (SELECT *, {_rule_case()} AS rule, ('0x' || md5(url)[1:7])::BIGINT % 5 = 0 AS held FROM u),
y AS (SELECT *, CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in _RULES)} END AS given, '^^^^' || url || '$' AS padded FROM w),
e AS (SELECT r, given, held, padded[i : i + 4] AS gram FROM y, unnest(range(1, length(padded) - 3)) AS t(i)),
g AS (SELECT gram, count(*) FILTER (WHERE NOT held AND given = 'allow') AS a, count(*) FILTER (WHERE NOT held AND given = 'block') AS b FROM e GROUP BY gram),
{_levels()},
m AS (SELECT gram, round(1000000 * (ln(qa) - ln(qb)))::BIGINT AS llr FROM p4),
s AS (SELECT r, greatest(-1000, least(1000, floor(sum(llr)::DOUBLE / (count(*) * 10000.0::DOUBLE))))::INTEGER AS bin FROM e JOIN m USING (gram) WHERE given IS NULL OR held GROUP BY r),
h AS (SELECT bin, count(*) FILTER (WHERE given = 'allow') AS a, count(*) FILTER (WHERE given = 'block') AS b FROM y JOIN s USING (r) WHERE held AND given IS NOT NULL GROUP BY bin),
k AS (SELECT bin, sum(a) OVER (ORDER BY bin DESC) * (SELECT sum(b) FROM h) - sum(b) OVER (ORDER BY bin DESC) * (SELECT sum(a) FROM h) AS gain FROM h),
t AS (SELECT coalesce(max_by(bin, (gain, -abs(bin), bin)), 0) AS bin FROM (SELECT bin, gain FROM k UNION ALL SELECT 0, 0))
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN s.bin >= t.bin THEN 'allow' ELSE 'block' END) AS verdict
FROM y LEFT JOIN s USING (r) CROSS JOIN t
"""

SUBSTRING_DEDUP = r"""
WITH
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS u(i)),
m AS (SELECT g, min(doc_id) AS first FROM o GROUP BY g),
c AS (SELECT DISTINCT r, k FROM o JOIN m USING (g), unnest(range(o.i, o.i + 13)) AS u(k) WHERE m.first < o.doc_id),
x AS (SELECT r, k, w[k] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(k)),
s AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM x ANTI JOIN c USING (r, k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(s.n, 0))::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r)
"""

RESAMPLE = rf"""
WITH
t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n::BIGINT], list_transform(range(0, 8), lambda z: 0::BIGINT)),
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS crc),
w AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
v AS (SELECT {_ITEM_WORDS} AS w FROM benchmark),
d AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w),
b AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM v),
x AS (SELECT g, hex(encode(g)) AS x, octet_length(encode(g)) AS n FROM (SELECT g FROM d UNION SELECT g FROM b)),
k AS (SELECT g, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, n), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
        lambda a, z: xor(a >> 8, t.crc[xor(a & 255, z) + 1])), 4294967295) % 10000 AS bucket FROM x, t),
s AS (SELECT bucket, count(*) AS n FROM d JOIN k USING (g) GROUP BY bucket),
q AS (SELECT bucket, count(*) AS n FROM b JOIN k USING (g) GROUP BY bucket),
a AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM q)::DOUBLE AS t),
e AS (SELECT bucket, floor(1000 * ln((coalesce(q.n, 0) + 1) * (a.s + 10000) / ((s.n + 1) * (a.t + 10000))))::BIGINT AS gain FROM s LEFT JOIN q USING (bucket), a),
f AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM d JOIN k USING (g) JOIN e USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT::DOUBLE AS h FROM w LEFT JOIN f USING (r)),
z AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM h),
y AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE words >= 20) OVER () AS many FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= many * 25 // 100 THEN place END AS rank FROM y
"""


def _rounds() -> str:
    out = []
    for i in range(7):
        out.append(
            f"a{i} AS MATERIALIZED (SELECT r, p, x.v, min((list_sum(list_transform(range(1, len(x.v) + 1), lambda j: (x.v[j] - c.v[j]) * (x.v[j] - c.v[j])))::BIGINT, c.e)) AS m FROM x JOIN c{i} c USING (p) GROUP BY r, p, x.v)"
        )
        if i < 6:
            out.append(f"s{i} AS (SELECT p, m[2] AS e, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i}, unnest(range(1, len(v) + 1)) AS u(j) GROUP BY p, m[2], j)")
            out.append(f"m{i} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY p, e)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.p = c.p AND m.e = c.e)")
    return ",\n".join(out)


VECTOR_CODES = rf"""
WITH
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS v FROM v, unnest(range(0, 8)) AS u(p)),
c0 AS MATERIALIZED (SELECT p, e, x.v FROM x JOIN (SELECT r, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS e FROM v ORDER BY vec_id LIMIT 16) USING (r)),
{_rounds()},
g AS (SELECT r, string_agg(right('0' || lower(hex(m[2])), 2), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM a6 GROUP BY r),
h AS (SELECT sha256(string_agg(n::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, j, v[j] AS n FROM c6, unnest(range(1, len(v) + 1)) AS u(j)))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN g USING (r), h
"""

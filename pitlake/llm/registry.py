"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .katz import score_texts
from .language_id import identify
from .lexical import search
from .license_scan import license_scan
from .near_dedup import near_duplicates
from .neighbours import nearest
from .packing import pack
from .quality import score_quality
from .repeats import remove_repeats
from .secret_scan import secret_scan
from .sharding import shard
from .spelling import spelling_groups


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_secret_scan, op3_decontaminate, op4_neighbours, op5_quality, op6_near_dedup, op7_packing, op8_language_id, op9_lm_score, op10_repeats, op11_spelling, op12_sharding, op13_lexical_search)}
ORACLES: dict[str, str] = {
    "op3_decontaminate": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*') AS ws FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
bs AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM b WHERE len(ws) >= 5)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*)::DOUBLE / n_item AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9
""",
    "op6_near_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM pair JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT u, u FROM (SELECT DISTINCT u FROM edge) UNION SELECT r.a, edge.v FROM r JOIN edge ON r.b = edge.u)
  SELECT a, min(b) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id, coalesce(least, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = d.doc_id
""",
    "op10_repeats": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, CAST(i AS BIGINT) AS i, hash(h[2 * i + 1:2 * i + 400]) AS k1, md5_number_lower(h[2 * i + 1:2 * i + 400]) AS k2
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY k1, k2) > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
o AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, list(struct_pack(a := before, b := a) ORDER BY a) AS kept FROM k GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN unhex(h) ELSE unhex(array_to_string(list_transform(kept, lambda x: h[2 * x.a + 1:2 * x.b]), '') || h[2 * last + 1:]) END) AS kept_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id
""",
    "op11_spelling": r"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, r, count(*) AS k FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) WHERE length(r) >= 5 GROUP BY ALL),
b AS (SELECT r, k, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || r)), '..'), lambda h: CAST(16 * (strpos('0123456789ABCDEF', h[1]) - 1) + strpos('0123456789ABCDEF', h[2]) - 1 AS BIGINT)) AS bytes FROM runs),
h AS (SELECT r, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1])), 4294967295) AS h FROM b, crc),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % 97 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, k FROM h) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
del AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
one AS (
  SELECT DISTINCT a.word, a.n, x.word AS near, x.n AS m FROM del a JOIN v x ON a.d = x.word
  UNION ALL SELECT DISTINCT x.word, x.n, a.word, a.n FROM del a JOIN v x ON a.d = x.word
  UNION ALL SELECT DISTINCT a.word, a.n, c.word, c.n FROM del a JOIN del c ON a.d = c.d AND a.i = c.i AND a.word <> c.word),
near AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, encode(near)) AS best, max(m) AS m FROM one GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN best END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN near ON near.word = v.word),
up AS (WITH RECURSIVE r(word, up_to) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.up_to WHERE f.form IS NOT NULL)
  SELECT r.word, r.up_to AS root FROM r JOIN f ON f.word = r.up_to WHERE f.form IS NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN up ON up.word = f.word
""",
    "op12_sharding": r"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
b AS (SELECT doc_id, x, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: CAST(16 * (strpos('0123456789ABCDEF', h[1]) - 1) + strpos('0123456789ABCDEF', h[2]) - 1 AS BIGINT)) AS bytes FROM d),
r AS (
  SELECT doc_id, CAST(strlen(x) + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1])), 4294967295) AS text_crc32,
         CAST('0x' || md5(x)[1:15] AS BIGINT) AS key
  FROM b, crc),
s AS (SELECT *, CAST(sum(size) OVER w AS BIGINT) - size AS start, row_number() OVER w - 1 AS place, CAST(sum(size) OVER () AS BIGINT) AS total FROM r WINDOW w AS (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, min(start) OVER (PARTITION BY key) AS group_start, CAST(sum(size) OVER (PARTITION BY key) AS BIGINT) AS group_size FROM s),
p AS (SELECT *, CAST(8 * CASE WHEN group_size * 160 <= total THEN 2 * group_start + group_size ELSE 2 * start + size END // (2 * total) AS INTEGER) AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
""",
    "op13_lexical_search": r"""
WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM dt GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
g AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY t, big_n),
q AS (SELECT item_id, t, count(*)::BIGINT AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
      FROM q JOIN w USING (t) JOIN tf USING (t) JOIN d USING (doc_id), g GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
""",
}

"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS win
  FROM (SELECT doc_id, k, w, unnest(range(0, len(w) - k + 1)) AS i FROM docs, ks WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.k, dw.i, iw.item_id FROM dw JOIN iw USING (k, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hit)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predictions

    return predictions(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def quality_rules_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules at a risk so high that small tables have labels enough: cutoffs are on there too."""
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), risk=0.6, delta=0.6, price=1).select(
        "doc_id", "base_failed", F.array_join("broken", ",").alias("broken"), "kept"
    )


def _op3_sql(risk: str, delta: str, price: int, rows: str) -> str:
    return OP3_CORE.replace("$RISK", risk).replace("$DELTA", delta).replace("$PRICE", str(price)) + rows


OP3_CORE = r"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09\x0B-\x0D]', '', 'g') <> '') AS l
  FROM documents),
tri AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, len(list_distinct(w)) AS n_distinct, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
    length(t) - length(regexp_replace(t, '[!?\x{a1}\x{bf}|]', '', 'g')) AS n_marks, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN least(floor(100 * n_symbols / word_chars), 100) ELSE 0 END AS symbols, CASE WHEN n_lines > 0 THEN least(floor(100 * n_dup_lines / n_lines), 100) ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN least(floor(100 * n_repeat_words / n_words), 100) ELSE 0 END AS repeats, CASE WHEN word_chars > 0 THEN least(floor(100 * n_upper / word_chars), 100) ELSE 0 END AS shouting,
    CASE WHEN n_words > 0 THEN least(floor(100 * n_marks / n_words), 100) ELSE 0 END AS marks, CASE WHEN n_words > 0 THEN least(floor(100 * (n_words - n_distinct) / n_words), 100) ELSE 0 END AS few_words
  FROM c),
v AS (
  SELECT doc_id, lang, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'shouting', 'marks', 'few_words']) AS rule, unnest([symbols, dup_lines, repeats, shouting, marks, few_words]) AS bin FROM f),
truth AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
b AS (
  SELECT lang, rule, bin, sum(CASE WHEN good = 1 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN good = 0 THEN 1 ELSE 0 END) AS bad
  FROM v JOIN truth ON truth.doc_id = v.doc_id WHERE NOT base_failed GROUP BY ALL),
st AS (
  SELECT lang, rule, bin, sum(good) OVER (PARTITION BY lang, rule ORDER BY bin DESC) AS n_false, sum(bad) OVER (PARTITION BY lang, rule ORDER BY bin DESC) AS n_caught,
    sum(good) OVER (PARTITION BY lang, rule) AS n_good FROM b),
ns AS (SELECT DISTINCT n_good AS n FROM st),
term AS (
  SELECT n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln($RISK / 6) + (n - i) * ln(1 - $RISK / 6)) AS p
  FROM (SELECT n, unnest(range(0, least(n, CAST(ceil(n * $RISK / 6) AS BIGINT)) + 1)) AS i FROM (SELECT CAST(n AS BIGINT) AS n FROM ns))),
ks AS (
  SELECT n, max(i) AS k FROM (SELECT n, i, sum(p) OVER (PARTITION BY n ORDER BY i) AS cdf FROM term) WHERE cdf <= $DELTA / (6 * (SELECT count(DISTINCT coalesce('=' || lang, '')) FROM b)) GROUP BY n),
cut AS (
  SELECT lang, rule, bin FROM st JOIN ks ON ks.n = st.n_good WHERE bin >= 1 AND n_false <= k AND n_caught - $PRICE * n_false > 0
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY n_caught - $PRICE * n_false DESC, bin DESC) = 1),
broken AS (SELECT v.doc_id, string_agg(v.rule, ',' ORDER BY v.rule) AS rules FROM v JOIN cut ON cut.lang IS NOT DISTINCT FROM v.lang AND cut.rule = v.rule AND v.bin >= cut.bin GROUP BY 1)
"""
OP3_SQL = _op3_sql(
    "0.05", "0.05", 20,
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept FROM f",
)
LOOSE_SQL = _op3_sql(
    "0.6", "0.6", 1,
    "SELECT f.doc_id, base_failed, coalesce(rules, '') AS broken, NOT base_failed AND rules IS NULL AS kept FROM f LEFT JOIN broken ON broken.doc_id = f.doc_id",
)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(concat_ws('|', '17', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS o
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
c AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s),
f AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM c),
lv AS (SELECT rest, ws, cap / w AS ratio, r AS at FROM f WHERE rest * w <= cap * ws ORDER BY ratio, r LIMIT 1),
t AS (
  SELECT f.source, f.source_size, CAST(CASE WHEN lv.at IS NULL OR (f.cap / f.w, f.r) < (lv.ratio, lv.at) THEN f.cap
    ELSE CAST(lv.rest * f.w AS DOUBLE) / CAST(lv.ws AS DOUBLE) END AS DOUBLE) AS target
  FROM f LEFT JOIN lv ON true),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, CAST(round(q.target) AS BIGINT) - q.whole * q.source_size AS quota,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, quota - ahead)) AS BIGINT) AS taken FROM p
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=2)


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i + 1] || ' ' || w[i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 1, least(len(w), 1)))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON comp.doc_id = d.doc_id
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_read

    return archive_and_read(_table(spark, sf_dir, "pages")).select(
        F.when(F.col("page") != "", F.col("page").cast("long")).alias("page_id"),  # a page without an id
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS hex FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(0, 8), lambda i:
    translate(lpad(lower(to_base(CAST('0x' || hex[i * 5 + 1 : i * 5 + 5] AS BIGINT), 32)), 4, '0'),
      '0123456789abcdefghijklmnopqrstuv', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents")).drop("detections")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    out = extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import deduplicated

    out = deduplicated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS s
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d) x
  LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p WHERE gone.p IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP10_SQL = r"""
WITH tbl AS (
  SELECT list(c ORDER BY i) AS k FROM (
    SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(0, 256)) AS i))),
bytes AS (
  SELECT DISTINCT t, list_transform(string_split_regex(regexp_replace(hex(encode(t)), '(..)', '\1 ', 'g'), ' '), lambda h: CASE WHEN h = '' THEN NULL ELSE CAST('0x' || h AS BIGINT) END) AS b
  FROM (SELECT coalesce(text, '') AS t FROM documents)),
crc AS (
  SELECT t, xor(list_reduce(list_prepend(4294967295, list_filter(b, lambda x: x IS NOT NULL)), lambda c, x: xor(c >> 8, k[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM bytes, tbl),
r AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS salt
  FROM documents JOIN crc ON crc.t = coalesce(text, '')),
o AS (
  SELECT *, sum(size) OVER (ORDER BY text_crc32, salt, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead, row_number() OVER (ORDER BY text_crc32, salt, doc_id, size) AS n, sum(size) OVER () AS total FROM r),
s AS (SELECT *, CAST((16 * (2 * ahead + size)) // (2 * total) AS INT) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_language_id, op3_quality_rules, quality_rules_loose, op4_mixing, op5_near_dedup, op6_warc, op7_licenses, op8_html_text, op9_substring_dedup, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op3_quality_rules": OP3_SQL, "quality_rules_loose": LOOSE_SQL, "op4_mixing": OP4_SQL, "op5_near_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op9_substring_dedup": OP9_SQL, "op10_sharding": OP10_SQL}

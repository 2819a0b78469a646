"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import clustering, htmltext, langid, lmscore, media, mixing, neardup, pii, quality, spelling, spm, toxicity, winnowing
from ridgeline.llm.kernels import id_crc, load

MIX_SEED = "mix-1"
SPM_SEED = 1


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken(load(spark, sf_dir, "documents"), seed=MIX_SEED)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
           / 4503599627370496.0 AS u
  FROM documents
), dw AS (
  SELECT *, pow(2.0, (length(bin(size)) // 2)) AS own FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS weight,
         source_size::DOUBLE * 2 AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS volume
  FROM s
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cap_before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from
  FROM w
), f AS (
  SELECT *, cap * weight_from <= weight * (volume - cap_before) AS is_full FROM o
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * ((volume
           - sum(CASE WHEN is_full THEN cap ELSE 0.0 END) OVER ()) / sum(CASE WHEN is_full THEN 0.0 ELSE weight END) OVER ()) END AS target
  FROM f
), g AS (
  SELECT t.source, t.source_size, t.target, dw.own, sum(dw.size) AS size
  FROM dw JOIN t ON dw.source IS NOT DISTINCT FROM t.source GROUP BY ALL
), h AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY own DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavier,
         sum(own * size) OVER (PARTITION BY source ORDER BY own DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass
  FROM g
), i AS (
  SELECT *, 2.0::DOUBLE * mass <= own * (target - 2.0::DOUBLE * heavier) AS at_most FROM h
), j AS (
  SELECT source, source_size, target, own, CASE WHEN at_most THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(
           own * ((target - sum(CASE WHEN at_most THEN 2.0::DOUBLE * size ELSE 0.0::DOUBLE END) OVER (PARTITION BY source))
                  / nullif(sum(CASE WHEN at_most THEN 0.0::DOUBLE ELSE own * size END) OVER (PARTITION BY source), 0.0::DOUBLE)), 0.0::DOUBLE))) END AS due
  FROM i
), r AS (
  SELECT dw.*, j.source_size, j.target, j.due
  FROM dw JOIN j ON dw.source IS NOT DISTINCT FROM j.source AND dw.own = j.own
), k AS (
  SELECT *, CAST(floor(due) AS BIGINT) AS whole, due - floor(due) AS p FROM r
), n AS (
  SELECT source, sum(whole * size) AS certain FROM k GROUP BY source
), q AS (
  SELECT k.*, CASE WHEN p > 0 THEN (u * (1.0 - p)) / ((1.0 - u) * p) END AS q,
         target - certain AS need
  FROM k JOIN n ON k.source IS NOT DISTINCT FROM n.source
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q) AS through,
         sum(size) OVER (PARTITION BY source, q) AS step
  FROM q WHERE q IS NOT NULL
), x AS (
  SELECT doc_id, size, source_size, target,
         whole + CASE WHEN through <= need OR (through - step < need AND need - (through - step) > through - need) THEN 1 ELSE 0 END AS n FROM c
  UNION ALL SELECT doc_id, size, source_size, target, whole FROM q WHERE q IS NULL
)
SELECT doc_id, size, source_size, target, CAST(n * size AS BIGINT) AS taken FROM x
"""

def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = id_crc("doc_id") % 4
    langs, model = langid.fit(docs, fold != 2)
    out = langid.predict(docs, langs, model)
    return out.select(F.col("id").alias("doc_id"), (id_crc("id") % 4 == 2).alias("held_out"), "lang_pred", "score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(load(spark, sf_dir, "documents"))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in pii.KINDS], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    fold = id_crc("doc_id") % 5
    labels = load(spark, sf_dir, "labels").filter(fold != 0).withColumn("part", F.when(fold == 1, 1).otherwise(0))
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select(
        F.col("id").alias("doc_id"), (id_crc("id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = lmscore.score(docs, id_crc("doc_id") % 5 != 1)
    return out.select(
        F.col("id").alias("doc_id"), (id_crc("id") % 5 == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the url rides along with the id, so that no join is needed
    pages = load(spark, sf_dir, "pages").withColumn("key", F.struct("page_id", "url"))
    out = htmltext.extract(pages, id_col="key")
    return out.select("id.page_id", "id.url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    # the digest rides along with the id, so that no join is needed
    docs = docs.withColumn("key", F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256")))
    out = spm.decode(spm.encode(docs.select("key", "text", "doc_id"), id_col="key", seed=SPM_SEED))
    decoded = F.sha2(F.col("text").cast("binary"), 256)
    return out.select(
        "id.doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"), decoded.alias("decoded_sha256"), (decoded == F.col("id.sha256")).alias("lossless"),
    )


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = f"coalesce(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
OP11_SQL = f"""
WITH i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ITEM_WORDS} AS w FROM benchmark
), v AS (
  SELECT DISTINCT item, array_to_string(w[p:p + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_ITEM_WORDS} AS w FROM documents
), r AS (
  SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n
), h AS (
  SELECT DISTINCT rid, p, n, item FROM (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM r) JOIN v USING (win, n)
), c AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + n)) AS q FROM h) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT 0 AS step, b AS byte, b AS x FROM range(256) t(b)
  UNION ALL SELECT step + 1, byte, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE step < 8
), steps AS MATERIALIZED (
  SELECT byte, x FROM bits WHERE step = 8
), runs AS MATERIALIZED (
  SELECT id, run, count(*) AS n, encode(id || ':' || run) AS raw
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY id, run
), shifted AS (
  SELECT 0 AS k, byte, x FROM steps UNION ALL SELECT 0, 256, 4294967295
  UNION ALL SELECT k + 1, s.byte, xor(s.x >> 8, t.x) FROM shifted s JOIN steps t ON t.byte = s.x & 255 WHERE k <= (SELECT max(octet_length(raw)) FROM runs)
), table_of AS MATERIALIZED (SELECT * FROM shifted),
spelled AS (
  SELECT id, run, octet_length(raw) - i - 1 AS k, CAST('0x' || substr(hex(raw), 2 * i + 1, 2) AS BIGINT) AS byte
  FROM (SELECT id, run, raw, unnest(range(octet_length(raw))) AS i FROM runs)
  UNION ALL SELECT id, run, octet_length(raw), 256 FROM runs
), hashed AS (
  SELECT id, run, xor(bit_xor(x), 4294967295) AS h FROM spelled JOIN table_of USING (k, byte) GROUP BY id, run
), words AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM runs JOIN hashed USING (id, run) GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), dels AS MATERIALIZED (
  SELECT word, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)
), pairs AS (
  SELECT a.word, b.word AS near FROM dels a JOIN dels b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM dels SEMI JOIN words w ON dels.rest = w.word
  UNION SELECT rest, word FROM dels SEMI JOIN words w ON dels.rest = w.word
), best AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.near, (-w.n, p.near)) AS near, max(w.n) AS near_n FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word
), forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)
), paths AS (
  SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT p.word, f.form, k + 1 FROM paths p JOIN forms f ON f.word = p.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(root, k) AS root FROM paths GROUP BY word
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms JOIN ends USING (word)
"""


def op13_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(load(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _op13_sql(rounds: int = 5) -> str:
    def nearest(c: str) -> str:
        """The vectors with the nearest of a table's centroids; all products are of whole numbers, exact as doubles."""
        squared = "list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c)"
        return f"SELECT rid, arg_min(i, (d, i)) AS i, CAST(min(d) AS BIGINT) AS d FROM (SELECT rid, i, {squared} AS d FROM kept, {c}) GROUP BY rid"

    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({nearest(f'c{r}')}), c{r + 1} AS MATERIALIZED (
  SELECT i, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN (
    SELECT i, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY j) AS c FROM (
      SELECT i, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT i, unnest(v)::BIGINT AS x, unnest(range(64)) AS j FROM kept JOIN a{r} USING (rid)) GROUP BY i, j)
    GROUP BY i) m USING (i))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS i, v AS c FROM (SELECT v, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept) ORDER BY h, v LIMIT 40
), {', '.join(steps)}, z AS MATERIALIZED ({nearest(f'c{rounds}')})
SELECT vec_id, CAST(z.i AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY z.i) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM kept JOIN z USING (rid) JOIN c{rounds} e ON e.i = z.i
"""


OP13_SQL = _op13_sql()

QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op5_media": op5_media, "op4_html": op4_html, "op3_lm_score": op3_lm_score, "op2_toxicity": op2_toxicity, "op6_neardup": op6_neardup, "op10_pii": op10_pii, "op7_mix": op7_mix, "op8_quality": op8_quality, "op9_langid": op9_langid, "op11_decontaminate": op11_decontaminate, "op12_spelling": op12_spelling, "op13_cluster": op13_cluster}
ORACLES = {"op7_mix": OP7_SQL, "op11_decontaminate": OP11_SQL, "op12_spelling": OP12_SQL, "op13_cluster": OP13_SQL}

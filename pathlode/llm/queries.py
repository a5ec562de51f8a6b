"""The registered queries of the operators, and SQL that gives the same rows where it can."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlode.llm import (
    clustering,
    decontamination,
    hard_negatives,
    html_text,
    language,
    line_dedup,
    mixing,
    secret_scan,
    sharding,
    simhash,
    token_cache,
    token_file,
    topk,
)
from pathlode.llm.common import stored, table, tokenizer_path
from pathlode.session import new_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(query: Query, sql: str | None = None) -> Query:
    QUERIES[query.__name__] = query
    if sql:
        ORACLE[query.__name__] = sql
    return query


# --- 2: mixing ---------------------------------------------------------------

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, {columns}
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM {documents}),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, source_size * 3 AS cap, nth,
         CASE nth % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM totals)),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                        0)::DOUBLE)
            / sum(weight) OVER (filling ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted WINDOW filling AS (ORDER BY cap / weight, nth)),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target
  FROM levels),
ranked AS (
  SELECT sized.*, source_size, target,
         row_number() OVER (
           PARTITION BY sized.source
           ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), ''))) - 1 AS nth,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         (('0x' || substr(md5('0:' || coalesce(sized.source, '')), 1, 3))::BIGINT + 0.5e0) / 4096
           AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
mixed AS (
  SELECT *, (floor(rate * (nth + 1) + u) - floor(rate * nth + u))::BIGINT AS copies FROM ranked)
"""


def op2_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", "source", mixing.word_count("text").alias("size")
    )
    return mixing.mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


register(
    op2_mix,
    MIX_SQL.format(columns="", documents="documents")
    + "SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed",
)


# --- 8: sharding -------------------------------------------------------------

SHARD_BYTES = 1024 * 1024


def op8_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", F.octet_length("text").alias("bytes")
    )
    return sharding.assign_shards(docs, SHARD_BYTES)


register(
    op8_shards,
    f"""
    WITH keyed AS (
      SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
             ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS bits
      FROM documents),
    tried AS (
      SELECT *, bits >> (60 - depth) AS p,
             sum(bytes) OVER same AS shard_bytes, count(*) OVER same AS shard_rows
      FROM keyed, (SELECT unnest(range(0, 61))::INTEGER AS depth)
      WINDOW same AS (PARTITION BY depth, bits >> (60 - depth))),
    fitting AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS nth
      FROM tried WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1)
    SELECT doc_id, bytes, 'b' || CASE depth WHEN 0 THEN '' ELSE lpad(bin(p), depth, '0') END AS shard,
           depth, shard_bytes::BIGINT AS shard_bytes, shard_rows
    FROM fitting WHERE nth = 1""",
)


# --- 3: main text ------------------------------------------------------------


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(table(spark, folder, "pages"))


register(op3_main_text)


# --- 4: near-duplicates ------------------------------------------------------


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    prints = stored(docs.select("doc_id", simhash.fingerprint_of("text").alias("fp")), "simhash")
    return simhash.near_duplicates(prints).select(
        "doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id"
    )


register(op4_simhash)


# --- 6: decontamination ------------------------------------------------------


def op6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontamination.find_leaks(docs, items)


register(op6_leaks)


# --- 7: language -------------------------------------------------------------


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(docs.select("doc_id", "text", "lang"))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(language.fold("doc_id") == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


register(op7_language)


# --- 9: token counts ---------------------------------------------------------


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    cache = new_folder(spark, "token-cache")
    counts = token_cache.count_tokens(docs, tokenizer_path(), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > token_cache.TOKEN_LIMIT)


register(op9_token_counts)


# --- 10: token files ---------------------------------------------------------


def op10_token_file(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    target = new_folder(spark, "token-file")
    token_file.write_ids(docs, target, tokenizer_path())
    return token_file.read_ids(spark, target, with_ids=False)


register(op10_token_file)


# --- 5: top-k search ---------------------------------------------------------


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = stored(topk.usable(table(spark, folder, "embeddings")), "vectors")
    index = topk.build_index(vectors)
    return topk.search(index, vectors.filter("vec_id % 100 = 0"))


register(
    op5_topk,
    """
    WITH vectors AS (
      SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) = len([x FOR x IN embedding IF isfinite(x)])),
    parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM vectors),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
      FROM parts q JOIN parts c ON q.k = c.k
      WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
          FROM scored) WHERE rank <= 10""",
)


# --- 1: secrets --------------------------------------------------------------


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, folder, "documents"))
    kinds = [*secret_scan.KINDS, *(f"like_{k}" for k in secret_scan.KINDS)]
    order = F.array(*[F.lit(k) for k in kinds])

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def placed(spans: str) -> Column:
        place = lambda s: F.array_position(order, s["kind"]).cast("int").alias("k")
        return F.transform(spans, lambda s: F.struct(s["start"], place(s), s["end"]))

    def listed(spans: Column) -> Column:
        name = lambda s: F.concat_ws(":", F.element_at(order, s["k"]), s["start"], s["end"])
        return F.array_join(F.transform(F.array_sort(spans), name), ",")

    return found.select(
        "doc_id",
        *[count(k) for k in secret_scan.KINDS],
        F.sha2(listed(placed("base")), 256).alias("base_sha256"),
        listed(F.concat(placed("base"), placed("learnt"))).alias("spans"),
        F.size("learnt").cast("long").alias("n_learnt"),
    )


register(op1_secrets)


# --- 11: centroid clustering -------------------------------------------------


def op11_clusters(spark: SparkSession, folder: str) -> DataFrame:
    vectors = stored(clustering.usable(table(spark, folder, "embeddings")), "cluster-vectors")
    return clustering.assign(vectors, clustering.fit(vectors))


_FLOORED = "((s - ((s % n) + n) % n) // n)::BIGINT"


def _cluster_round(k: int) -> str:
    return f"""
    near{k} AS (
      SELECT vec_id, v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
      FROM (SELECT kept.vec_id, kept.v, c.cluster,
                   list_sum([(kept.v[i] - c.v[i]) * (kept.v[i] - c.v[i])
                             FOR i IN range(1, 65)])::BIGINT AS distance
            FROM kept, centroids{k} c) GROUP BY vec_id, v)"""


def _cluster_update(k: int) -> str:
    return f"""
    sums{k} AS (
      SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n
      FROM near{k - 1}, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i),
    means{k} AS (SELECT cluster, list({_FLOORED} ORDER BY i) AS v FROM sums{k} GROUP BY cluster),
    centroids{k} AS (
      SELECT c.cluster, coalesce(m.v, c.v) AS v
      FROM centroids{k - 1} c LEFT JOIN means{k} m ON c.cluster = m.cluster)"""


register(
    op11_clusters,
    """
    WITH kept AS (
      SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
      WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF isfinite(x)]) = 64),
    centroids0 AS (
      SELECT row_number() OVER (ORDER BY mark) - 1 AS cluster, v
      FROM (SELECT v, sha256('1:' || vec_id) AS mark FROM kept ORDER BY mark LIMIT 16)),"""
    + _cluster_round(0)
    + "".join(f",{_cluster_update(k)},{_cluster_round(k)}" for k in (1, 2, 3))
    + """
    SELECT vec_id, near3.cluster::INTEGER AS cluster, distance,
           (sum(distance) OVER (PARTITION BY near3.cluster))::BIGINT AS cluster_inertia,
           (sum(distance) OVER ())::BIGINT AS inertia,
           sha256(array_to_string(centroids3.v, ',')) AS centroid_sha256
    FROM near3 JOIN centroids3 ON near3.cluster = centroids3.cluster""",
)


# --- 12: line dedup ----------------------------------------------------------


def op12_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.drop_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


register(
    op12_lines,
    r"""
    WITH docs AS (
      SELECT row_number() OVER () AS nth, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
      FROM documents),
    lines AS (
      SELECT nth, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
    keyed AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM lines),
    frequent AS (
      SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT nth) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(frequent.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                           FILTER (WHERE frequent.key IS NULL), '')) AS kept_sha256
    FROM keyed LEFT JOIN frequent ON keyed.key = frequent.key GROUP BY nth, doc_id""",
)


# --- 13: hard negatives ------------------------------------------------------


def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings")
    vectors = stored(hard_negatives.usable(rows, label=moved), "labelled-vectors")
    index = hard_negatives.build_index(vectors)
    return hard_negatives.mine(index, vectors.filter("vec_id % 100 = 0"))


register(
    op13_negatives,
    """
    WITH vectors AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(embedding) = len([x FOR x IN embedding IF isfinite(x)])),
    scored AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             list_sum([a.v[i] * c.v[i] FOR i IN range(1, len(a.v) + 1)])::BIGINT AS score
      FROM vectors a, vectors c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score
      FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth
            FROM scored WHERE same) WHERE nth <= 5),
    ranked AS (
      SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id
                                ORDER BY s.score DESC, s.vec_id) AS rank
      FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
       AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
    FROM ranked WHERE rank <= 10""",
)

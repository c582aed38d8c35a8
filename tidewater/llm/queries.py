"""The queries of the training-data operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    from tidewater.llm import language

    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit(docs.select("doc_id", "text", "lang").where(~held))
    found = language.identify(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of at most 2048 tokens."""
    from tidewater.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a motion-JPEG file: stored, read back, and cut into clips."""
    from tidewater.llm import media

    files = media.write_avi(_table(spark, sf_dir, "documents"))
    read = media.read_avi(files, ["doc_id", "n_bytes"])
    clip = F.transform("clips", lambda c: F.format_string("%d-%d:%.3f", c["start_ms"], c["end_ms"], c["level"]))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.format_string("frames=%d", F.aggregate("clips", F.lit(0), lambda a, c: a + c["frames"])), F.concat_ws(",", clip)).alias("feature"),
    )


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from tidewater.llm import extract

    pages = _table(spark, sf_dir, "pages")
    found = extract.extract(pages, extract.fit(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of all conversations with its repaired role and its piece of the rendering."""
    from tidewater.llm import chat

    return chat.repair(_table(spark, sf_dir, "conversations"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives, normalised to a member per record, and read back."""
    from tidewater.llm import warc

    folder, files = warc.archive_pages(_table(spark, sf_dir, "pages"))
    read = warc.read_archives(files.repartition(max(1, min(files.count(), 4096))), folder)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a mixture whose source weights go as the square root of their sizes."""
    from tidewater.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents").select("doc_id", "source"), alpha=0.5)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50."""
    from tidewater.llm import topk

    vectors = topk.integer_vectors(_table(spark, sf_dir, "embeddings"), scale=256)
    return topk.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical Pitman-Yor scores of all documents; learns from those not held out."""
    from tidewater.llm import pitman_yor as lm

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))
    model = lm.fit(docs.where("not held_out"))
    return lm.score(docs, model, ["doc_id", "held_out"]).withColumn("train_tokens", F.lit(model.n).cast("long"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents, links at up to 4 differing bits."""
    from tidewater.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three rounds over 16 centroids."""
    from tidewater.llm import centroids

    return centroids.cluster(centroids.integer_vectors(_table(spark, sf_dir, "embeddings"), scale=64, size=64), k=16, rounds=3, seed=1)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations, rebuilt on the first turns of their family's."""
    from tidewater.llm import prefix_trie

    turns = prefix_trie.number_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuild(turns, family=20, heads=4))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; labels are learned from rows that are not held out."""
    from tidewater.llm import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    drawn, sizes = toxicity.draw_labels(labels.where(~held))
    model = toxicity.fit(docs.join(F.broadcast(drawn), "doc_id"), sizes=sizes)  # about 12,000 ids
    found = toxicity.score(docs, model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_packing, op3_media, op4_extract, op5_chat, op6_warc, op7_mixing, op8_topk, op9_pitman_yor, op10_simhash, op11_centroids, op12_prefix_trie, op13_toxicity)}


def _rounds(n: int) -> str:
    """The clustering as SQL: a pair of relations for each round."""
    nearest = """a{r} AS (
                SELECT v.id, v.vec_id, v.v, arg_min(c.j, (list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c.j)) AS j,
                       min(list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) AS distance
                FROM v, c{r} c GROUP BY ALL
            )"""
    move = """, s{r} AS (
                SELECT j, d, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{p}) GROUP BY j, d
            ), c{r} AS (
                SELECT j, coalesce(m.c, c.c) AS c FROM c{p} c
                LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY d) AS c FROM s{r} GROUP BY j) m USING (j)
            ), """
    return (
        """WITH v AS MATERIALIZED (
                SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), c0 AS (
                SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM v WHERE vec_id IS NOT NULL
                ORDER BY sha256('1:' || vec_id), v LIMIT 16
            ), """
        + "".join(nearest.format(r=r) + (move.format(r=r + 1, p=r) if r < n else "") for r in range(n + 1))
        + f"""
            SELECT vec_id, j::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY j)::BIGINT AS cluster_inertia,
                   sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
            FROM a{n} JOIN c{n} USING (j)"""
    )


def oracle_sql() -> dict[str, str]:
    return {
        "op6_warc": """
            WITH p AS (
                SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                       sha1(coalesce(html, '')) AS payload_digest
                FROM pages
            ), m AS (
                SELECT *, max(page_id) OVER (PARTITION BY html) AS chosen FROM p
            )
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 1000 AND chosen IS NOT NULL AND page_id IS DISTINCT FROM chosen THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 1000 AND chosen IS NOT NULL AND page_id IS DISTINCT FROM chosen THEN chosen END AS refers_to
            FROM m""",
        "op8_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
            )
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
            FROM s QUALIFY rank <= 5""",
        "op11_centroids": _rounds(3),
        "op12_prefix_trie": r"""
            WITH t AS (
                SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), id) AS d, id, words
                FROM (SELECT *, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
                             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)
            ), c AS (
                SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS donor, xor(list_reduce(
                    list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
                    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: k::UBIGINT)),
                                             lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % 4 AS h
                FROM t
            ), r AS (
                SELECT c.conv_id, 0 AS own, d, id, words FROM c JOIN t ON t.conv_id = c.donor WHERE d <= h
                UNION ALL SELECT conv_id, 1, d, id, words FROM c JOIN t USING (conv_id) WHERE d > h
            ), s AS (
                SELECT conv_id, coalesce(ids, []) AS ids, coalesce(words, []) AS words FROM c
                LEFT JOIN (SELECT conv_id, list(id ORDER BY own, d) AS ids, list(words ORDER BY own, d) AS words FROM r GROUP BY conv_id) USING (conv_id)
            ), p AS (
                SELECT conv_id, depth, ids[1:depth] AS path, coalesce(words[depth], 0) AS w, depth = len(ids) AS ends FROM s, unnest(range(len(ids) + 1)) u(depth)
            ), n AS (
                SELECT depth, path, path[1:depth - 1] AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, bool_and(ends) AS leaf,
                       sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
                FROM p GROUP BY depth, path
            ), k AS (
                SELECT above AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above
            ), b AS (
                SELECT path[1:i] AS path, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens FROM n, unnest(range(depth + 1)) u(i) GROUP BY 1
            )
            SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves,
                   saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
            FROM n LEFT JOIN n m ON m.depth = n.depth - 1 AND m.path = n.above LEFT JOIN k ON k.path = n.path JOIN b ON b.path = n.path""",
    }

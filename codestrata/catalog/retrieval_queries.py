"""Retrieval queries: follow-ups, embeddings, candidate lists, fusion, boosts, evidence, recall."""
from pyspark.sql import functions as F

from ..functions import prefix, text, vectors
from ..operators import retrieval
from ..session import cut_lineage
from . import bindings as b

# Conversations with some turns replaced by requests for more, so both branches occur.
_TURNS = """SELECT conv_id, turn, role, CASE WHEN length(text) % 4 = 0 THEN CASE WHEN role = 'user' THEN ' Tell me more about it?! ' ELSE 'explain in detail' END ELSE text END AS text
FROM conversations"""


def r1(spark, folder):
    b.open_tables(spark, folder)
    return retrieval.followup_topic(spark.sql(_TURNS)).select("conv_id", "turn", "context_only", F.md5("topic").alias("topic"))


R1_SQL = f"""WITH turns AS (SELECT *, text IN (' Tell me more about it?! ', 'explain in detail') AS context_only FROM ({_TURNS}) t)
SELECT conv_id, turn, context_only, CASE WHEN context_only THEN md5(last_value(CASE WHEN role = 'user' AND NOT context_only THEN substr(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), 1, 1000) END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS topic FROM turns"""


def _chunks(spark, folder):
    b.open_tables(spark, folder)
    return spark.sql(b.CHUNKS), spark.sql(b.QUESTIONS)


_written: dict = {}


def _written_chunks(spark, folder):
    """As ``_chunks``, for what reads the texts more than once: they meet their labels once per session and folder."""
    chunks, questions = _chunks(spark, folder)
    key = (spark.sparkContext.applicationId, folder)
    if key not in _written:
        _written[key] = cut_lineage(chunks)
    return _written[key], questions


def r3(spark, folder):
    chunks, _ = _written_chunks(spark, folder)
    items = chunks.select(F.col("chunk_id").alias("id"), F.sha2("text", 256).alias("input_hash"), F.col("text").alias("embedding_text"), "kind")
    cache = retrieval.hash_encoder(items.where("kind = 'function'").select("input_hash", "embedding_text").dropDuplicates(["input_hash"]), "embedding_text").select(
        "input_hash", F.lit("m").alias("embedding_config"), "embedding").where("embedding IS NOT NULL")
    ready, _ = retrieval.embed_missing(items.drop("kind"), cache, "m")
    return ready.select("id", F.expr("aggregate(transform(embedding, (x, i) -> x * (i + 1)), 0.0D, (a, x) -> a + x)").alias("checksum")).withColumn("checksum", F.round("checksum", 4))


_HASHED = r"""tokens AS (SELECT chunk_id, lower(unnest(regexp_extract_all(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'))) AS term FROM chunks),
buckets AS (SELECT chunk_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM tokens GROUP BY ALL),
lengths AS (SELECT chunk_id, sqrt(sum(n * n)) AS length FROM buckets GROUP BY chunk_id)"""
R3_SQL = b.with_chunks("SELECT b.chunk_id AS id, round(sum(n / length * (bucket + 1)), 4) AS checksum FROM buckets b JOIN lengths l ON l.chunk_id = b.chunk_id GROUP BY b.chunk_id", _HASHED)


def r4(spark, folder):
    chunks, _ = _chunks(spark, folder)
    placed = prefix.dense_ordinal(chunks.select("analysis_id", "ord", retrieval.token_cost(F.col("text")).alias("cost")), ["analysis_id"], "ord", "position")
    return placed.select("analysis_id", "position", "cost")


R4_SQL = b.with_chunks("SELECT analysis_id, row_number() OVER (PARTITION BY analysis_id ORDER BY ord) AS position, octet_length(encode(text)) + 128 AS cost FROM chunks")


def r4_batches(spark, folder):
    return retrieval.pack_batches(r4(spark, folder), 18_000)


_R4_JUMPS = """placed AS MATERIALIZED (SELECT analysis_id, row_number() OVER (PARTITION BY analysis_id ORDER BY ord) AS position, octet_length(encode(text)) + 128 AS cost FROM chunks),
sums AS (SELECT *, sum(cost) OVER (PARTITION BY analysis_id ORDER BY position ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS c2, sum(cost) OVER (PARTITION BY analysis_id ORDER BY position ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS c3,
  sum(cost) OVER (PARTITION BY analysis_id ORDER BY position ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS c4, sum(cost) OVER (PARTITION BY analysis_id ORDER BY position ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS c5,
  sum(cost) OVER (PARTITION BY analysis_id ORDER BY position ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS c6, sum(cost) OVER (PARTITION BY analysis_id ORDER BY position ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS c7,
  sum(cost) OVER (PARTITION BY analysis_id ORDER BY position ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS c8 FROM placed),
jumps AS MATERIALIZED (SELECT analysis_id, position, position + CASE WHEN c2 > 18000 THEN 1 WHEN c3 > 18000 THEN 2 WHEN c4 > 18000 THEN 3 WHEN c5 > 18000 THEN 4 WHEN c6 > 18000 THEN 5 WHEN c7 > 18000 THEN 6
  WHEN c8 > 18000 THEN 7 ELSE 8 END AS nxt FROM sums)"""
R4_BATCHES_SQL = b.with_chunks("""SELECT p.analysis_id, p.position, p.cost, max(w.position) AS batch_start FROM placed p JOIN walk w ON w.analysis_id = p.analysis_id AND w.position <= p.position
  AND w.position > p.position - 8 GROUP BY ALL""", f"""{_R4_JUMPS},
walk AS (SELECT analysis_id, position, nxt FROM jumps WHERE position = 1 UNION ALL SELECT j.analysis_id, j.position, j.nxt FROM walk w JOIN jumps j ON j.analysis_id = w.analysis_id AND j.position = w.nxt)""").replace("WITH ", "WITH RECURSIVE ", 1)


def r4_calls(spark, folder):
    """A day whose requests end three quarters of the way through each snapshot."""
    placed = cut_lineage(r4(spark, folder))
    left = placed.groupBy("analysis_id").agg(F.floor(F.count("*") * 3 / 4).cast("long").alias("left"))
    return retrieval.calls_of_a_day(retrieval.pack_batches(placed, 18_000), left, 18_000)


R4_CALLS_SQL = b.with_chunks("SELECT analysis_id, start AS call_start, CASE WHEN size <= room THEN size ELSE 0 END AS size, refusals + CASE WHEN size <= room THEN 0 ELSE 1 END AS refusals FROM walk WHERE size <= room OR size = 1",
                             f"""{_R4_JUMPS},
ends AS (SELECT analysis_id, max(position) AS n FROM placed GROUP BY analysis_id),
sizes AS MATERIALIZED (SELECT analysis_id, position, least(nxt - position, n - position + 1) AS size, n * 3 // 4 AS room FROM jumps JOIN ends USING (analysis_id)),
walk AS (SELECT analysis_id, position AS start, size, room, 0 AS refusals FROM sizes WHERE position = 1
  UNION ALL SELECT z.analysis_id, z.position, CASE WHEN w.size <= w.room THEN z.size ELSE w.size // 2 END, CASE WHEN w.size <= w.room THEN w.room - w.size ELSE w.room END, CASE WHEN w.size <= w.room THEN 0 ELSE w.refusals + 1 END
  FROM walk w JOIN sizes z ON z.analysis_id = w.analysis_id AND z.position = CASE WHEN w.size <= w.room THEN w.start + w.size ELSE w.start END WHERE w.size <= w.room OR w.size > 1)""").replace("WITH ", "WITH RECURSIVE ", 1)

_SPACES = """SELECT vec_id, embedding, label, concat('m:64:v', vec_id % 2) AS embedding_config FROM embeddings"""


def _vector_inputs(spark, folder):
    """One question per topic and space: the mean direction of the vectors of a label, against all vectors of the space."""
    b.open_tables(spark, folder)
    items = spark.sql(_SPACES).select(F.lit("v").alias("analysis_id"), "embedding_config", F.col("vec_id").alias("item_id"), "embedding", "label")
    parts = items.select("embedding_config", "label", F.posexplode("embedding").alias("at", "x")).groupBy("embedding_config", "label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy("embedding_config", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
    asked = means.select(F.concat_ws("#", "embedding_config", "label").alias("request_id"), F.lit("v").alias("analysis_id"), "embedding_config", vectors.unit(F.col("mean")).alias("embedding"), "label")
    return items, asked


def r5(spark, folder):
    items, asked = _vector_inputs(spark, folder)
    return retrieval.vector_topk(asked, items).select("request_id", "item_id", F.round("score", 6).alias("score"), "rank")


_COSINE = f"""spaced AS ({_SPACES}), spread AS (SELECT embedding_config, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM spaced),
means AS (SELECT embedding_config, label, pos, avg(x) AS x FROM spread GROUP BY ALL),
queries AS (SELECT embedding_config, label, list(x ORDER BY pos) AS q FROM means GROUP BY ALL),
scored AS (SELECT concat(s.embedding_config, '#', q.label) AS request_id, q.label AS asked, s.vec_id AS item_id, s.label, round(list_dot_product(q.q, s.embedding::DOUBLE[]) / sqrt(list_dot_product(q.q, q.q)), 9) AS score
  FROM spaced s JOIN queries q ON q.embedding_config = s.embedding_config),
top20 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS rank FROM scored QUALIFY rank <= 20)"""
R5_SQL = f"WITH {_COSINE} SELECT request_id, item_id, round(score, 6) AS score, rank FROM top20"


def r6(spark, folder):
    chunks, questions = _written_chunks(spark, folder)
    return retrieval.lexical_topk(questions, chunks)


_BM25 = r"""words AS MATERIALIZED (SELECT analysis_id, chunk_id, lower(unnest(regexp_extract_all(regexp_replace(concat_ws(' ', text, path, symbol), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'))) AS term FROM chunks),
sizes AS (SELECT c.analysis_id, c.chunk_id, count(w.term) AS length FROM chunks c LEFT JOIN words w ON w.chunk_id = c.chunk_id GROUP BY ALL),
means AS (SELECT analysis_id, avg(length) AS mean, count(*) AS n FROM sizes GROUP BY ALL),
tf AS MATERIALIZED (SELECT analysis_id, chunk_id, term, count(*) AS tf FROM words GROUP BY ALL), df AS (SELECT analysis_id, term, count(*) AS df FROM tf GROUP BY ALL),
asked AS (SELECT DISTINCT request_id, analysis_id, lower(unnest(regexp_extract_all(regexp_replace(question, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'))) AS term FROM questions),
bm AS (SELECT a.request_id, t.chunk_id, round(sum(ln(1 + (m.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * s.length / m.mean))), 6) AS score FROM asked a
  JOIN tf t ON t.analysis_id = a.analysis_id AND t.term = a.term JOIN df d ON d.analysis_id = a.analysis_id AND d.term = a.term JOIN sizes s ON s.chunk_id = t.chunk_id JOIN means m ON m.analysis_id = a.analysis_id GROUP BY ALL),
lexical AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS rank FROM bm QUALIFY rank <= 20)"""
R6_SQL = b.with_chunks("SELECT request_id, chunk_id, score, rank FROM lexical", _BM25)


def r7(spark, folder):
    _, questions = _chunks(spark, folder)
    return questions.select("request_id", F.array_join(F.array_sort(text.search_terms(F.col("question"))), " ").alias("terms"))


R7_SQL = b.with_chunks(r"""SELECT request_id, string_agg(term, ' ' ORDER BY term) AS terms FROM (SELECT DISTINCT request_id,
  lower(unnest(regexp_extract_all(regexp_replace(question, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'))) AS term FROM questions) x GROUP BY request_id""")


def _lists(spark, folder):
    chunks, questions = _written_chunks(spark, folder)
    coded = retrieval.hash_encoder(chunks, "text").where("embedding IS NOT NULL").select("analysis_id", F.lit("m").alias("embedding_config"), F.col("chunk_id").alias("item_id"), "embedding")
    asked = retrieval.hash_encoder(questions, "question").where("embedding IS NOT NULL").select("request_id", "analysis_id", F.lit("m").alias("embedding_config"), "embedding")
    near = retrieval.vector_topk(asked, coded).withColumnRenamed("item_id", "chunk_id")
    return chunks, questions, near, retrieval.lexical_topk(questions, chunks)


def r8(spark, folder):
    _, _, near, lexical = _lists(spark, folder)
    return retrieval.fuse([near, lexical]).withColumn("score", F.round("score", 9))


_NEAR = r"""hwords AS (SELECT chunk_id AS id, lower(unnest(regexp_extract_all(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'))) AS term FROM chunks
  UNION ALL SELECT request_id, lower(unnest(regexp_extract_all(regexp_replace(question, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'))) FROM questions),
hb AS (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM hwords GROUP BY ALL),
hv AS MATERIALIZED (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM hb),
pairs AS (SELECT q.request_id, c.chunk_id, round(sum(a.x * z.x), 9) AS score FROM questions q JOIN chunks c ON c.analysis_id = q.analysis_id JOIN hv a ON a.id = q.request_id
  JOIN hv z ON z.id = c.chunk_id AND z.bucket = a.bucket GROUP BY ALL),
nearest AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS rank FROM pairs QUALIFY rank <= 20),
fused AS MATERIALIZED (SELECT request_id, chunk_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT request_id, chunk_id, rank FROM nearest UNION ALL SELECT request_id, chunk_id, rank FROM lexical) u GROUP BY ALL)"""
R8_SQL = b.with_chunks("SELECT request_id, chunk_id, round(score, 9) AS score FROM fused", _BM25, _NEAR)


def _candidates(spark, folder):
    chunks, questions, near, lexical = _lists(spark, folder)
    fused = cut_lineage(retrieval.fuse([near, lexical]).join(questions, "request_id"))
    rows = fused.join(chunks.drop("analysis_id"), "chunk_id")
    return rows.withColumn("module_hit", F.col("path").startswith("src1")).withColumn("any_module", F.lit(True)).withColumn(
        "selected", F.col("path").contains("/services/")).withColumn("selection_named", F.col("question").rlike("(?i)the"))


def r9(spark, folder):
    return retrieval.boosted(_candidates(spark, folder)).select("request_id", "chunk_id", F.round("score", 6).alias("score"))


_R9 = r"""terms AS (SELECT request_id, list(DISTINCT term) AS words FROM asked WHERE term NOT IN ('a','an','and','are','by','does','explain','for','how','in','is','of','the','this','to','what','where','work') GROUP BY request_id),
boosted AS MATERIALIZED (SELECT f.request_id, f.chunk_id, c.file_id, f.score + CASE WHEN c.path LIKE 'src1%' THEN 0.035 ELSE 0 END
  + CASE WHEN list_has_any(coalesce(w.words, []), ['bundle']) OR contains(regexp_replace(lower(q.question), '[^a-z0-9]', '', 'g'), 'bundle') THEN 0.055 ELSE 0 END
  + CASE WHEN list_has_any(coalesce(w.words, []), string_split(lower(regexp_replace(c.symbol, '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' ')) THEN 0.025 ELSE 0 END
  + CASE WHEN c.path LIKE '%/services/%' THEN CASE WHEN regexp_matches(q.question, '(?i)the') THEN 0.07 ELSE 0.015 END ELSE 0 END
  + CASE c.kind WHEN 'function' THEN 0.015 WHEN 'declarations' THEN 0.02 ELSE 0 END
  + least(tl, 1200) / 1200 * 0.018 - CASE WHEN tl < 80 THEN 0.06 WHEN tl < 180 THEN 0.02 ELSE 0 END
  - CASE WHEN c.path LIKE '%/test/%' AND NOT list_has_any(coalesce(w.words, []), ['test', 'tests', 'testing']) THEN 0.035 ELSE 0 END AS score
  FROM fused f JOIN questions q ON q.request_id = f.request_id JOIN (SELECT *, length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) AS tl FROM chunks) c ON c.chunk_id = f.chunk_id
  LEFT JOIN terms w ON w.request_id = f.request_id)"""
R9_SQL = b.with_chunks("SELECT request_id, chunk_id, round(score, 6) AS score FROM boosted", _BM25, _NEAR, _R9)


def r10(spark, folder):
    """Questions of the conversations that name one of the parts, as file names."""
    b.open_tables(spark, folder)
    nodes = spark.sql("SELECT 'p' AS analysis_id, concat('file:', p_partkey) AS id, 'file' AS kind, p_name AS name, concat(p_type, '/', p_brand, '/', p_partkey) AS path, CAST(NULL AS STRING) AS file_id FROM part")
    asked = spark.sql("SELECT concat(o_orderkey, '') AS request_id, 'p' AS analysis_id, concat('How does ', o_orderpriority, ' relate to ', p_name, ' and ', p_type, ' #', p_brand, '?') AS question "
                      "FROM orders JOIN part ON p_partkey = o_orderkey")
    return retrieval.named_files(asked, nodes).select("request_id", "file_id", "rank")


R10_SQL = r"""WITH named AS (SELECT concat('file:', p_partkey) AS file_id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS needle, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS module, p_type FROM part),
asked AS (SELECT concat(o_orderkey, '') AS request_id, regexp_replace(lower(concat('How does ', o_orderpriority, ' relate to ', p_name, ' and ', p_type, ' #', p_brand, '?')), '[^a-z0-9]', '', 'g') AS compact FROM orders JOIN part ON p_partkey = o_orderkey)
SELECT request_id, file_id, rank FROM (SELECT request_id, file_id, row_number() OVER (PARTITION BY request_id ORDER BY file_id) AS rank FROM (
  SELECT DISTINCT request_id, file_id FROM asked JOIN named ON (length(needle) >= 4 AND contains(compact, needle)) OR (length(p_type) >= 5 AND contains(compact, module))) x) y WHERE rank <= 80"""


def r11(spark, folder):
    nodes, edges = b.graph(spark, folder)
    seeds = spark.sql("SELECT concat('g:cur#', s_nationkey) AS request_id, 'g:cur' AS analysis_id, CAST(pick AS INT) AS seed_no, concat('file:s', s_suppkey) AS node_id, CAST(1 + s_nationkey % 2 AS INT) AS depth "
                      "FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS pick FROM supplier) s WHERE pick <= 8")
    related, kept = retrieval.graph_expansion(seeds, nodes, edges)
    return related.select("request_id", F.col("node").alias("item"), F.lit("node").alias("what")).unionByName(kept.select("request_id", F.col("id").alias("item"), F.lit("edge").alias("what")))


def _ranked(spark, folder):
    from ..functions.ranking import top_per_group
    scored = retrieval.boosted(_candidates(spark, folder))
    return retrieval.diversify(top_per_group(scored, ["request_id"], [F.desc("score"), F.col("chunk_id")], 450))


def r12(spark, folder):
    return _ranked(spark, folder).select("request_id", "chunk_id", "place")


_PLACED = """SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN first AND lead <= 8 THEN 0 ELSE 1 END, rank) AS place FROM (
  SELECT *, rank = min(rank) OVER (PARTITION BY request_id, file_id) AS first, sum(CASE WHEN fr = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY rank) AS lead FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, file_id ORDER BY rank) AS fr FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM boosted) a) c) d"""
R12_SQL = b.with_chunks(_PLACED, _BM25, _NEAR, _R9)


def r13(spark, folder):
    return retrieval.select_evidence(_ranked(spark, folder))


# One step per candidate in order; each adds itself to what is kept or leaves it as it was.
R13_SQL = b.with_chunks("SELECT request_id, chunk_id, len(kept) AS number FROM walk WHERE joined", _BM25, _NEAR, _R9, f"""placed AS MATERIALIZED ({_PLACED}),
judged AS (SELECT p.request_id, p.place, c.chunk_id, c.file_id, c.start_line AS s, c.end_line AS e, length(c.text) + {retrieval.EVIDENCE_EXTRA} AS cost, CASE WHEN c.path LIKE 'src1%' THEN 0 ELSE 1 END AS away,
    CASE WHEN regexp_matches(q.question, '{retrieval.RELATION_PATTERN}') THEN 2 ELSE 0 END AS away_limit, CASE WHEN regexp_matches(q.question, '(?i)the') THEN 3 ELSE 2 END AS per_file,
    NOT regexp_matches(q.question, '{retrieval.TEST_PATTERN}') AND (contains(lower(c.path), '/test/') OR lower(c.path) LIKE '%test.java')
    OR length(regexp_replace(regexp_replace(c.text, '^\\s+', ''), '\\s+$', '')) < 20 AND count(*) OVER (PARTITION BY p.request_id) > 1
    OR NOT regexp_matches(q.question, '{retrieval.BUILD_PATTERN}') AND regexp_matches(lower(c.path), '/(pom[.]xml|package[.]json|build[.]gradle([.]kts)?|pyproject[.]toml|requirements[.]txt)$') AS refused
  FROM placed p JOIN questions q ON q.request_id = p.request_id JOIN chunks c ON c.chunk_id = p.chunk_id),
candidates AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY place) AS turn FROM judged WHERE NOT refused),
walk AS (SELECT request_id, CAST(0 AS BIGINT) AS turn, '' AS chunk_id, false AS joined, CAST([] AS STRUCT(f VARCHAR, s BIGINT, e BIGINT, cost BIGINT, away INTEGER)[]) AS kept FROM candidates WHERE turn = 1
  UNION ALL SELECT request_id, turn, chunk_id, fits, CASE WHEN fits THEN list_append(kept, {{'f': file_id, 's': s, 'e': e, 'cost': cost, 'away': away}}) ELSE kept END
  FROM (SELECT c.*, w.kept, len(w.kept) < {retrieval.EVIDENCE_CHUNKS} AND coalesce(list_sum([k.cost for k in w.kept]), 0) + c.cost <= {retrieval.EVIDENCE_CHARS}
      AND (c.away = 0 OR coalesce(list_sum([k.away for k in w.kept]), 0) < c.away_limit) AND len([k for k in w.kept if k.f = c.file_id]) < c.per_file
      AND (c.e < c.s OR len(list_distinct(flatten([generate_series(greatest(k.s, c.s), least(k.e, c.e)) for k in w.kept if k.f = c.file_id]))) <= {retrieval.EVIDENCE_OVERLAP} * (c.e - c.s + 1)) AS fits
    FROM walk w JOIN candidates c ON c.request_id = w.request_id AND c.turn = w.turn + 1) x)""").replace("WITH ", "WITH RECURSIVE ", 1)


def r14(spark, folder):
    chunks, questions = _written_chunks(spark, folder)
    picked = retrieval.lexical_topk(questions, chunks).select("request_id", "chunk_id", F.col("rank").alias("number"))
    files = chunks.groupBy("analysis_id", "file_id").agg(F.expr("max(end_line) - 10").alias("line_count"))
    return retrieval.evidence_registry(picked, chunks, files).select("request_id", "citation_id", "label", "valid")


R14_SQL = b.with_chunks("""SELECT l.request_id, concat('S', l.rank) AS citation_id, concat(c.path, ':', c.start_line, '-', c.end_line) AS label, c.end_line <= f.line_count AS valid FROM lexical l
  JOIN chunks c ON c.chunk_id = l.chunk_id JOIN (SELECT analysis_id, file_id, max(end_line) - 10 AS line_count FROM chunks GROUP BY ALL) f ON f.analysis_id = c.analysis_id AND f.file_id = c.file_id""", _BM25)


def r15(spark, folder):
    chunks, questions = _written_chunks(spark, folder)
    picked = cut_lineage(retrieval.lexical_topk(questions, chunks, 16)).join(chunks.select("chunk_id", "path", "text"), "chunk_id")
    sources = picked.select("request_id", F.lit("source").alias("part"), F.col("rank").alias("position"), F.to_json(F.struct(F.concat(F.lit("S"), "rank").alias("citationId"), "path", F.col("text").alias("code"))).alias("body"))
    turns = questions.select("request_id", F.lit("turn").alias("part"), F.explode(F.array(F.lit(1), F.lit(2))).alias("position"), F.to_json(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))).alias("body"))
    asked = questions.select("request_id", F.lit("question").alias("part"), F.lit(1).alias("position"), F.to_json(F.array("question")).alias("body"))
    edges = picked.select("request_id", F.lit("edge").alias("part"), F.col("rank").alias("position"), F.to_json(F.struct(F.col("chunk_id").alias("id"), "path")).alias("body"))
    return retrieval.bound_payload(sources.unionByName(turns).unionByName(asked).unionByName(edges))


def r18(spark, folder):
    items, asked = _vector_inputs(spark, folder)
    found = retrieval.vector_topk(asked, items).join(items.select("item_id", "label"), "item_id").select("request_id", "rank", F.concat_ws("/", "label", "item_id").alias("path"))
    expected = items.join(asked.select("request_id", "embedding_config", "label"), ["embedding_config", "label"]).select("request_id", F.concat_ws("/", "label", "item_id").alias("path"))
    return retrieval.recall_at_k(found, expected)


R18_SQL = f"""WITH {_COSINE} SELECT concat(s.embedding_config, '#', s.label) AS request_id, count(*) AS expected, count(t.item_id) AS found, round(count(t.item_id) / count(*), 6) AS recall
FROM spaced s LEFT JOIN top20 t ON t.rank <= 10 AND t.item_id = s.vec_id AND t.request_id = concat(s.embedding_config, '#', s.label) GROUP BY s.embedding_config, s.label"""


def r18_macro(spark, folder):
    return retrieval.macro_recall(r18(spark, folder))


R18_MACRO_SQL = f"SELECT round(avg(recall), 6) AS recall, count(*) AS requests, round(avg(recall), 6) >= 0.85 AS passed FROM ({R18_SQL}) q"


def r20(spark, folder):
    b.open_tables(spark, folder)
    profiles = spark.sql("SELECT vec_id, concat('p:chunk-v2:model-', label, CASE WHEN label = 4 THEN ':wide' ELSE ':64' END, ':v', vec_id % 2) AS profile FROM embeddings")
    return retrieval.vector_space(profiles).select("vec_id", "model", "dimensions", "embedding_config")


R20_SQL = "SELECT vec_id, concat('model-', label) AS model, CAST(64 AS INT) AS dimensions, concat('model-', label, ':64:v', vec_id % 2) AS embedding_config FROM embeddings WHERE label <> 4"

QUERIES = {
    "r1_followup_topic": (r1, R1_SQL), "r3_embed_batch_job": (r3, R3_SQL), "r4_token_cost": (r4, R4_SQL), "r4_token_batching": (r4_batches, R4_BATCHES_SQL), "r4_calls_of_a_day": (r4_calls, R4_CALLS_SQL),
    "r5_vector_topk": (r5, R5_SQL), "r6_lexical_topk": (r6, R6_SQL), "r7_search_terms": (r7, R7_SQL), "r8_rrf_fusion": (r8, R8_SQL), "r9_rank_boosts": (r9, R9_SQL),
    "r10_target_files": (r10, R10_SQL), "r11_graph_expansion": (r11, None), "r12_diversify": (r12, R12_SQL), "r13_evidence_select": (r13, R13_SQL),
    "r14_evidence_registry": (r14, R14_SQL), "r15_payload_budget": (r15, None), "r18_recall_at_k": (r18, R18_SQL), "r18_macro_recall": (r18_macro, R18_MACRO_SQL), "r20_query_vs_index_space": (r20, R20_SQL),
}

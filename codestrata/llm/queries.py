"""The registered queries of the training-data operators, and the SQL that checks those which SQL can express."""
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import binary_packing, chat, collocations, decontaminate, exact_dedup, importance, jaccard_join, language_model, packing
from codestrata.llm import token_files, toxicity, url_rules, warc
from codestrata.llm.common import table

WORD_TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def token_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.encode_and_read(spark, table(spark, folder, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def class_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score(table(spark, folder, "documents"), language_model.hashed_seventh())


def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, folder, "pages"))


def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = exact_dedup.dedup(docs, exact_dedup.by_arrival(docs, 4))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"), toxicity.hashed_third())
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def jaccard_groups(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.groups(table(spark, folder, "documents"))


def benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_hash")


def chat_rendering(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(table(spark, folder, "conversations"))


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_rules.judge(table(spark, folder, "pages"), rules)


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


def target_draw(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("n_words")


def binary_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return binary_packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(BYTE_TOKENIZER))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

EXACT_SQL = f"""
WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(other), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

CHAT_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position,
           '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line FROM conversations),
h AS (SELECT conv_id, position, line, md5(string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY position)) AS h,
      count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
inner_ones AS (SELECT DISTINCT position, h FROM h WHERE position < n_turns - 1),
lasts AS (SELECT conv_id, position, h, row_number() OVER (PARTITION BY h ORDER BY conv_id) AS nth FROM h WHERE position = n_turns - 1),
stay AS (SELECT conv_id FROM lasts ANTI JOIN inner_ones USING (position, h) WHERE nth = 1)
SELECT conv_id, n_turns, position // 256 AS part, string_agg(line, '' ORDER BY position) AS text
FROM h SEMI JOIN stay USING (conv_id) GROUP BY 1, 2, 3
"""

URL_SQL = r"""
WITH rules(host_r, path_r, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                              ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
r AS (SELECT page_id, row_number() OVER () AS row_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, row_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT row_id, host_r || path_r AS rule, action, row_number() OVER (PARTITION BY row_id ORDER BY length(host_r || path_r) DESC) AS nth
      FROM p JOIN rules ON (host = host_r OR ends_with(host, '.' || host_r)) AND starts_with(path, path_r))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE nth = 1) USING (row_id)
"""

PHRASE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (SELECT lang, unnest(string_split_regex(LOWERED, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
runs AS (SELECT lang, size, words[i:i + size - 1] AS run FROM pieces, (VALUES (1), (2), (3)) sizes(size), unnest(range(1, len(words) - size + 2)) places(i)),
f AS (SELECT lang, size, run, count(*) AS n FROM runs GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1),
c AS (SELECT lang, size, run, n AS a FROM f WHERE size > 1 AND n >= 10),
cuts AS (SELECT c.*, k, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score
  FROM c, (VALUES (1), (2)) ks(k)
  JOIN f x ON x.lang = c.lang AND x.run = c.run[:k] JOIN f y ON y.lang = c.lang AND y.run = c.run[k + 1:] WHERE k < c.size),
worst AS (SELECT lang, size, run, a, min({'score': score, 'k': k, 'l': l, 'r': r}) AS cut FROM cuts GROUP BY ALL),
best AS (SELECT lang, size, run, a, cut.l AS l, cut.r AS r, cut.score AS score FROM worst),
inner_ones AS (SELECT lang, run[s:s + 1] AS run, max(a) AS longer FROM c, (VALUES (1), (2)) starts(s) WHERE size = 3 GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.run, ' ') AS phrase FROM best LEFT JOIN inner_ones i ON i.lang = best.lang AND i.run = best.run
  WHERE NOT coalesce(100 * i.longer >= 50 * a, false))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n, score::BIGINT AS score
  FROM kept JOIN total USING (lang)) WHERE rank <= 2000
""".replace("LOWERED", LOWERED)

QUERIES = {
    "op1_best_fit_packing": (best_fit_packing, None),
    "op2_token_files": (token_output, None),
    "op3_lm_scoring": (class_model_scores, None),
    "op4_warc": (warc_round_trip, WARC_SQL),
    "op5_toxicity": (toxic_scores, None),
    "op6_jaccard_join": (jaccard_groups, JACCARD_SQL),
    "op7_decontamination": (benchmark_passages, None),
    "op8_exact_dedup": (exact_copies, EXACT_SQL),
    "op9_chat_formatting": (chat_rendering, CHAT_SQL),
    "op10_url_filter": (url_filter, URL_SQL),
    "op11_collocations": (phrases, PHRASE_SQL),
    "op12_importance_resampling": (target_draw, None),
    "op13_binary_packing": (binary_pieces, None),
}

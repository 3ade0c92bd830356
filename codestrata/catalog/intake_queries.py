"""Snapshot intake and keyed writes."""
from pyspark.sql import functions as F

from .. import schemas
from ..functions import identity, paths
from ..sources import change_records, keyed, snapshots
from ..session import cut_lineage
from . import bindings as b


_files: dict[tuple[str, str], object] = {}


def files_of(spark, folder):
    """Profiled, eligible files of both snapshots of every source, written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    m = b.members(spark, folder).drop("text", "lang", "member")
    if key not in _files:
        _files[key] = cut_lineage(snapshots.profile_files(m.where(paths.is_eligible(F.col("path")))))
    return _files[key]


def s2(spark, folder):
    m = b.members(spark, folder)
    # Every document lists its member once; a changed copy lists it again, a third of the pages are links or folders.
    listing = m.select(F.col("analysis_id").alias("archive"), (F.col("ord") * 2).alias("seq"), F.col("member").alias("name"),
                       F.when(F.col("lang") == "de", "dir").otherwise("file").alias("type"),
                       F.octet_length("content").cast("long").alias("size"))
    again = m.where(F.col("content").endswith("\nchanged")).select(
        F.col("analysis_id").alias("archive"), (F.col("ord") * 2 + 1).alias("seq"),
        F.when(F.col("lang") == "en", F.col("member")).otherwise(F.concat(F.lit("/"), "member")).alias("name"),
        F.when(F.col("lang") == "fr", "link").otherwise("file").alias("type"),
        F.octet_length("content").cast("long").alias("size"))
    out = snapshots.archive_members(listing.unionByName(again), max_entries=60, max_expanded=400_000, max_file=9_000)
    return out.select("archive", "seq", "path", "entries", "expanded", "verdict")


S2_SQL = b.with_members("""
SELECT l.archive, l.seq, CASE WHEN name LIKE '/%' THEN NULL ELSE path END AS path, entries, expanded,
  CASE WHEN entries > 60 THEN 'reject:entries' WHEN name LIKE '/%' THEN 'reject:path'
       WHEN type NOT IN ('file', 'dir') THEN 'reject:link' WHEN type = 'dir' THEN 'skip'
       WHEN expanded > 400000 THEN 'reject:expanded' WHEN NOT wanted THEN 'skip'
       WHEN l.seq > first_seq THEN 'reject:duplicate' WHEN size > 9000 THEN 'oversized' ELSE 'accept' END AS verdict
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY archive ORDER BY seq) AS BIGINT) AS entries,
             CAST(sum(CASE WHEN type = 'file' THEN size ELSE 0 END) OVER (PARTITION BY archive ORDER BY seq) AS BIGINT) AS expanded,
             min(CASE WHEN type = 'file' AND wanted THEN seq END) OVER (PARTITION BY archive, path, name LIKE '/%') AS first_seq
      FROM listing) l""", """
listing AS (
  SELECT analysis_id AS archive, ord * 2 AS seq, member AS name, path, CASE WHEN lang = 'de' THEN 'dir' ELSE 'file' END AS type,
         octet_length(encode(content)) AS size, ord % 12 NOT IN (6, 7) AS wanted FROM members
  UNION ALL
  SELECT analysis_id, ord * 2 + 1, CASE WHEN lang = 'en' THEN member ELSE concat('/', member) END, path,
         CASE WHEN lang = 'fr' THEN 'link' ELSE 'file' END, octet_length(encode(content)), ord % 12 NOT IN (6, 7) AND lang = 'en'
  FROM members WHERE content LIKE concat('%', chr(10), 'changed'))""")


def s3(spark, folder):
    m = b.members(spark, folder)
    awkward = (F.when(F.col("lang") == "fr", F.concat(F.lit("./"), F.replace("member", F.lit("/"), F.lit("//"))))
               .when(F.col("lang") == "de", F.replace("member", F.lit("-main/"), F.lit("-main/../")))
               .when(F.col("lang") == "es", F.concat(F.lit("C:"), "member")).otherwise(F.col("member")))
    named = m.withColumn("name", awkward)
    return named.select("analysis_id", "ord", snapshots.clean_member(F.col("name")).alias("path"),
                        snapshots.unsafe_member(F.col("name")).alias("unsafe"))


S3_SQL = b.with_members("""
SELECT analysis_id, ord, CASE WHEN lang IN ('de', 'es') THEN NULL ELSE path END AS path, lang IN ('de', 'es') AS unsafe
FROM members""")


def s4(spark, folder):
    m = b.members(spark, folder)
    return m.select("analysis_id", "path", paths.is_eligible(F.col("path")).alias("eligible"))


S4_SQL = b.with_members("""
SELECT analysis_id, path, (regexp_matches(path, '\\.(js|mjs|ts|tsx|py|java)$') AND NOT path LIKE '%.min.js')
   OR regexp_matches(path, '/(package\\.json|requirements\\.txt|pom\\.xml|README\\.md)$') AS eligible
FROM members""")


def s5(spark, folder):
    return files_of(spark, folder).select("analysis_id", "path", "language", "line_count", "content_hash", "redacted")


S5_SQL = b.with_members("""
SELECT analysis_id, path, language, length(content) - length(replace(content, chr(10), '')) + 1 AS line_count,
       sha256(content) AS content_hash, ord % 12 <> 8 AS redacted FROM files""")


def s6(spark, folder):
    m = b.members(spark, folder)
    masked = snapshots.profile_files(m)
    stars = F.length("content") - F.length(F.replace("content", F.lit("*"), F.lit("")))
    return masked.select("analysis_id", "path", F.length("content").cast("long").alias("characters"),
                         stars.cast("long").alias("stars"), "line_count", "redacted")


S6_SQL = b.with_members("""
SELECT analysis_id, path, length(content) AS characters,
       length(content) - length(replace(content, '*', '')) + CASE WHEN ord % 12 = 8 THEN 0 ELSE 32 END AS stars,
       length(content) - length(replace(content, chr(10), '')) + 1 AS line_count, ord % 12 <> 8 AS redacted FROM members""")


def s7(spark, folder):
    return snapshots.snapshot_limits(b.members(spark, folder))


S7_SQL = b.with_members(f"""
SELECT analysis_id, CAST(sum(CASE WHEN size <= {schemas.MAX_FILE_BYTES} THEN 1 ELSE 0 END) AS BIGINT) AS files,
  CAST(sum(CASE WHEN size <= {schemas.MAX_FILE_BYTES} THEN size ELSE 0 END) AS BIGINT) AS text_bytes,
  CAST(sum(CASE WHEN size > {schemas.MAX_FILE_BYTES} THEN 1 ELSE 0 END) AS BIGINT) AS oversized,
  CASE WHEN sum(CASE WHEN size <= {schemas.MAX_FILE_BYTES} THEN 1 ELSE 0 END) > {schemas.MAX_FILES} THEN 'files'
       WHEN sum(CASE WHEN size <= {schemas.MAX_FILE_BYTES} THEN size ELSE 0 END) > {schemas.MAX_TEXT_BYTES}
       THEN 'text_bytes' END AS over_limit
FROM (SELECT analysis_id, octet_length(encode(content)) AS size FROM members) m GROUP BY analysis_id""")


def s8(spark, folder):
    log = b.bound(spark, folder, b.LOG)
    return keyed.upsert(log.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


S8_SQL = """
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"""


def s9(spark, folder):
    log = b.bound(spark, folder, b.LOG).select("user_id", "event_id", "event_type", "value")
    signup = keyed.upsert(log.where("event_type = 'signup' AND value > 40"), ["user_id"], "event_id")
    return keyed.insert_absent(signup, log, ["user_id"], "event_id")


S9_SQL = """
WITH kept AS (SELECT user_id, event_id, event_type, value FROM events WHERE event_type = 'signup' AND value > 40
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT * FROM kept UNION ALL
(SELECT user_id, event_id, event_type, value FROM events WHERE user_id NOT IN (SELECT user_id FROM kept)
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)"""


def s10(spark, folder):
    log = b.bound(spark, folder, b.LOG).select("user_id", "event_type", "event_id", "ts")
    jobs = keyed.upsert(log, ["user_id"], "event_id").select("user_id", F.col("event_type").alias("status"),
                                                            F.col("ts").alias("heartbeat_at"))
    seen = keyed.upsert(log.where("event_type <> 'error'"), ["user_id"], "event_id").select(
        "user_id", F.col("event_type").alias("status"), F.col("ts").alias("heartbeat_at"))
    return keyed.conditional_update(jobs, seen, ["user_id"], ["status", "heartbeat_at"], {"status": F.lit("running")})


S10_SQL = """
WITH jobs AS (SELECT user_id, event_type AS status, ts AS heartbeat_at FROM events
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id, CASE WHEN status <> 'error' THEN 'running' ELSE status END AS status, heartbeat_at,
       status <> 'error' AS matched FROM jobs"""


def s11(spark, folder):
    m = b.members(spark, folder)
    analyses = m.select("analysis_id", "repository_id").distinct()
    doomed = spark.sql("SELECT source AS repository_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 "
                       "GROUP BY source HAVING count(*) >= 3")
    left = keyed.delete_repository({"members": m.select("analysis_id"), "languages": m.select("analysis_id", "lang").distinct()},
                                   analyses, doomed)
    frames = [frame.agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left")
              for name, frame in left.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


S11_SQL = b.with_members("""
SELECT 'members' AS table_name, count(*) AS rows_left FROM members WHERE repository_id NOT IN (SELECT source FROM doomed)
UNION ALL SELECT 'languages', count(*) FROM (SELECT DISTINCT analysis_id, lang FROM members
                                             WHERE repository_id NOT IN (SELECT source FROM doomed)) x
UNION ALL SELECT 'analyses', count(DISTINCT analysis_id) FROM members WHERE repository_id NOT IN (SELECT source FROM doomed)""",
"doomed AS (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source HAVING count(*) >= 3)")


def s12(spark, folder):
    b.open_tables(spark, folder)
    return keyed.find(spark.table("orders"), equals={"o_orderstatus": "O"}, any_of={"o_orderpriority": ["5-LOW", "2-HIGH"]},
                      unequal={"o_custkey": 7}, drop=["o_totalprice", "o_orderdate"], order=["o_orderkey"])


S12_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority IN ('5-LOW', '2-HIGH') AND o_custkey IS DISTINCT FROM 7
ORDER BY o_orderkey LIMIT 200000"""


def s13_commits(spark, folder):
    b.open_tables(spark, folder)
    lines = spark.sql("""
      SELECT to_json(named_struct('sha', sha1(cast(d.doc_id AS string)), 'commit', named_struct(
        'message', CASE WHEN d.lang = 'de' THEN '' ELSE d.text END,
        'author', named_struct('name', CASE WHEN l.quality = 1 THEN d.source END, 'date', '2024-01-01T00:00:00Z'),
        'committer', named_struct('name', CASE WHEN l.toxic = 0 THEN concat('bot-', d.lang) END,
                                  'date', CASE WHEN l.quality = 0 THEN '2024-02-02T00:00:00Z' END)))) AS value
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
    return change_records.commits(lines)


S13_COMMITS_SQL = """
SELECT sha1(cast(d.doc_id AS string)) AS sha,
  CASE WHEN d.lang = 'de' THEN 'Untitled commit' ELSE substr(string_split(d.text, chr(10))[1], 1, 240) END AS message,
  CASE WHEN l.quality = 1 THEN d.source WHEN l.toxic = 0 THEN concat('bot-', d.lang) ELSE 'Unknown author' END AS author,
  CASE WHEN l.quality = 0 THEN '2024-02-02T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS committed_at
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def s13_changed_files(spark, folder):
    m = b.members(spark, folder)
    lines = m.select(F.to_json(F.struct(
        F.col("path").alias("filename"), F.when(F.col("lang") == "fr", F.concat(F.lit("old/"), "path")).alias("previous_filename"),
        F.when(F.col("lang") == "fr", "renamed").alias("status"), F.length("text").cast("long").alias("additions"),
        F.col("content").alias("patch"))).alias("value"))
    out = change_records.changed_files(lines)
    return out.withColumn("patch", F.md5("patch"))


S13_FILES_SQL = b.with_members("""
SELECT path AS filename, CASE WHEN lang = 'fr' THEN concat('old/', path) END AS previous_filename,
  CASE WHEN lang = 'fr' THEN 'renamed' ELSE 'modified' END AS status, length(text) AS additions, CAST(0 AS BIGINT) AS deletions,
  md5(CASE WHEN cut LIKE '%";%' AND contains(cut, concat('const password = "', md5(text), '"'))
           THEN replace(cut, concat('const password = "', md5(text), '"'), concat('const password = "', repeat('*', 32), '"'))
           ELSE cut END) AS patch,
  length(content) > 12000 AS patch_truncated, contains(cut, concat('const password = "', md5(text), '"')) AS redacted
FROM (SELECT *, substr(content, 1, 12000) AS cut FROM members) m""")


def s13_pulls(spark, folder):
    b.open_tables(spark, folder)
    lines = spark.sql("""
      SELECT to_json(named_struct('number', o_orderkey, 'title', CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END,
        'user', named_struct('login', concat('u', o_custkey)), 'state', CASE WHEN o_orderstatus = 'P' THEN 'closed' END,
        'merged_at', CASE WHEN o_orderstatus = 'F' THEN cast(o_orderdate AS string) END,
        'base', named_struct('ref', 'main', 'sha', sha1(cast(o_custkey AS string))),
        'head', named_struct('ref', 'topic', 'sha', CASE WHEN o_totalprice > 1000 THEN sha1(cast(o_orderkey AS string)) ELSE 'bad' END))
      ) AS value FROM orders""")
    return change_records.pull_requests(lines)


S13_PULLS_SQL = """
SELECT o_orderkey AS number, CASE WHEN o_orderpriority = '5-LOW' THEN 'Untitled pull request' ELSE o_orderpriority END AS title,
  concat('u', o_custkey) AS author,
  CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'P' THEN 'closed' ELSE 'open' END AS state, false AS draft, '' AS updated_at,
  'main' AS base_ref, 'topic' AS head_ref, sha1(cast(o_custkey AS string)) AS base_sha, sha1(cast(o_orderkey AS string)) AS head_sha,
  '' AS url FROM orders WHERE o_totalprice > 1000"""


def s14(spark, folder):
    files = files_of(spark, folder)
    out = identity.corpus_digest(files)
    return out.withColumn("analysis_key", identity.analysis_key(F.col("analysis_id"), F.col("corpus_hash"), F.lit("v1")))


S14_SQL = b.with_members("""
SELECT analysis_id, sum(n)::BIGINT AS file_count, sha1(string_agg(concat(bucket, h), chr(10) ORDER BY bucket)) AS corpus_hash,
  substr(sha256(concat(analysis_id, ':', sha1(string_agg(concat(bucket, h), chr(10) ORDER BY bucket)), ':v1')), 1, 24) AS analysis_key
FROM (SELECT analysis_id, substr(sha1(path), 1, 3) AS bucket, count(*) AS n,
        sha1(string_agg(concat(path, chr(0), sha256(content)), chr(10) ORDER BY path)) AS h FROM files GROUP BY 1, 2) GROUP BY analysis_id""")

QUERIES = {
    "s2_archive_manifest_check": (s2, S2_SQL), "s3_archive_path_clean": (s3, S3_SQL), "s4_eligible_filter": (s4, S4_SQL),
    "s5_file_profile": (s5, S5_SQL), "s6_redact_secrets": (s6, S6_SQL), "s7_snapshot_limits": (s7, S7_SQL),
    "s8_keyed_upsert": (s8, S8_SQL), "s9_insert_if_absent": (s9, S9_SQL), "s10_conditional_update": (s10, S10_SQL),
    "s11_keyed_delete": (s11, S11_SQL), "s12_filtered_find": (s12, S12_SQL),
    "s13_change_records_commits": (s13_commits, S13_COMMITS_SQL), "s13_change_records_files": (s13_changed_files, S13_FILES_SQL),
    "s13_change_records_pulls": (s13_pulls, S13_PULLS_SQL), "s14_snapshot_identity": (s14, S14_SQL),
}

"""Commit, changed-file and pull-request records from JSON lines."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text


def _or_default(value: Column, default: str) -> Column:
    return F.when(value.isNull() | (value == ""), F.lit(default)).otherwise(value)


def first_line(message: Column) -> Column:
    return F.element_at(F.split(message, f"\\r\\n|[{text.LINE_BREAKS}]", 2), 1)


def commits(lines: DataFrame) -> DataFrame:
    c = lines.select(F.from_json("value", schemas.COMMIT_JSON).alias("j")).select("j.*")
    author = F.coalesce(F.nullif(F.col("commit.author.name"), F.lit("")), F.nullif(F.col("commit.committer.name"), F.lit("")))
    date = F.coalesce(F.nullif(F.col("commit.committer.date"), F.lit("")), F.nullif(F.col("commit.author.date"), F.lit("")))
    return c.where(F.col("sha").rlike("^[a-f0-9]{40}$")).select(
        "sha", F.substring(first_line(_or_default(F.col("commit.message"), "Untitled commit")), 1, 240).alias("message"),
        F.substring(_or_default(author, "Unknown author"), 1, 100).alias("author"),
        F.coalesce(date, F.lit("")).alias("committed_at"))


def changed_files(lines: DataFrame, patch_limit: int = 12000) -> DataFrame:
    """Patch cut to the limit, then redacted; flags say whether either happened."""
    f = lines.select(F.from_json("value", schemas.CHANGED_FILE_JSON).alias("j")).select("j.*")
    cut = F.substring("patch", 1, patch_limit)
    cleaned = text.redact(cut)
    return f.select(
        F.substring(F.coalesce("filename", F.lit("")), 1, 2048).alias("filename"),
        F.when(F.col("previous_filename") != "", F.substring("previous_filename", 1, 2048)).alias("previous_filename"),
        _or_default(F.col("status"), "modified").alias("status"),
        F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"),
        cleaned.alias("patch"), F.coalesce(F.length("patch") > patch_limit, F.lit(False)).alias("patch_truncated"),
        F.coalesce(cleaned != cut, F.lit(False)).alias("redacted"))


def pull_requests(lines: DataFrame) -> DataFrame:
    p = lines.select(F.from_json("value", schemas.PULL_JSON).alias("j")).select("j.*")
    sha = "^[a-f0-9]{40}$"
    return p.where(F.col("number").isNotNull() & F.col("base.sha").rlike(sha) & F.col("head.sha").rlike(sha)).select(
        "number", F.substring(_or_default(F.col("title"), "Untitled pull request"), 1, 300).alias("title"),
        F.substring(_or_default(F.col("user.login"), "Unknown author"), 1, 100).alias("author"),
        F.when(F.col("merged_at") != "", "merged").otherwise(_or_default(F.col("state"), "open")).alias("state"),
        F.coalesce("draft", F.lit(False)).alias("draft"), F.coalesce("updated_at", F.lit("")).alias("updated_at"),
        F.substring(F.coalesce("base.ref", F.lit("")), 1, 256).alias("base_ref"),
        F.substring(F.coalesce("head.ref", F.lit("")), 1, 256).alias("head_ref"),
        F.col("base.sha").alias("base_sha"), F.col("head.sha").alias("head_sha"), F.coalesce("html_url", F.lit("")).alias("url"))


def repository_url(url: Column, host: str) -> Column:
    """Owner and name of a repository root URL on one host; null when the URL is anything else."""
    clean = F.trim(url)
    pattern = r"^https://[^/?#]+/([A-Za-z0-9][A-Za-z0-9-]{0,38})/([A-Za-z0-9_.-]{1,100}?)(?:\.git)?/*$"
    name = F.regexp_extract(clean, pattern, 2)
    valid = (clean.rlike(pattern) & (F.lower(F.regexp_extract(clean, "^https://([^/?#]+)/", 1)) == host)
             & ~name.isin(".", ".."))
    return F.when(valid, F.struct(F.regexp_extract(clean, pattern, 1).alias("owner"), name.alias("name")))

"""Stable identifiers."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(*parts: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, length)


def analysis_key(repository: Column, commit: Column, profile: Column) -> Column:
    return digest(F.concat_ws(":", repository, commit, profile))


def edge_key(source: Column, target: Column, kind: Column, file_id: Column, line: Column, specifier: Column) -> Column:
    joined = F.concat_ws("\u0000", source, target, kind, F.coalesce(file_id, F.lit("")),
                         F.coalesce(line.cast("string"), F.lit("")), F.coalesce(specifier, F.lit("")))
    return F.concat(F.lit("edge:"), F.substring(F.sha2(joined, 256), 1, 24))


BUCKET_DIGITS = 3      # hexadecimal digits of a path's hash: 4,096 buckets to a snapshot


def corpus_digest(files: DataFrame) -> DataFrame:
    """file_count and a digest of every (path, content_hash) of each snapshot, of whatever size.

    Files fall into buckets by the hash of their path. A bucket's digest is the sha1 of its path-ordered ``path +
    content_hash`` lines, the snapshot's that of its bucket-ordered ``bucket + digest`` lines: no list holds more than one
    bucket's files or the 4,096 buckets.
    """
    bucket = F.substring(F.sha1("path"), 1, BUCKET_DIGITS)
    lines = files.groupBy("analysis_id", bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat("path", F.lit("\u0000"), "content_hash"))).alias("l"))
    told = lines.select("analysis_id", "n", F.concat("bucket", F.sha1(F.array_join("l", "\n"))).alias("told"))
    return told.groupBy("analysis_id").agg(F.sum("n").alias("file_count"), F.sha1(F.array_join(F.array_sort(F.collect_list("told")), "\n")).alias("corpus_hash"))

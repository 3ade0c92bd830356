"""Snapshot intake: directory trees and archive listings to file records, with the path, size and secret rules."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import paths, prefix, text
from ..functions.binding import let


def unsafe_member(name: Column) -> Column:
    """Backslash, NUL, absolute, drive-letter or parent-directory names."""
    return name.rlike(r"[\\\u0000]|^/|^[A-Za-z]:|(^|/)\.\.(/|$)")


def clean_member(name: Column) -> Column:
    """Snapshot path of an archive member: the leading folder is dropped; null when nothing is left."""
    def rest(parts: Column) -> Column:
        return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/"))
    return let(name, lambda n: F.when(~unsafe_member(n), let(F.filter(F.split(n, "/"), lambda p: ~p.isin("", ".")), rest)))


def scan_directory(spark: SparkSession, root: str, analysis_id: str, max_file: int | None = None) -> DataFrame:
    """Eligible files below a folder as (analysis_id, path, raw, ord); all of them, or those of at most ``max_file`` bytes.

    ``oversized_in`` lists what such a limit leaves out.
    """
    base = root.rstrip("/") + "/"
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
              .select(F.regexp_replace("path", "^file:/+", "/").alias("full"), "length", "content"))
    relative = listed.withColumn("path", F.substring("full", F.lit(len(base) + 1), F.length("full")))
    kept = relative.where(paths.is_eligible(F.col("path")))
    if max_file is not None:
        kept = kept.where(F.col("length") <= max_file)
    return kept.select(F.lit(analysis_id).alias("analysis_id"), "path", F.col("content").alias("raw"),
                       F.xxhash64("path").alias("ord"))


def decode_text(raw: Column) -> Column:
    """UTF-8 text of bytes; null for NUL-bearing or undecodable content; a leading byte-order mark is dropped."""
    decoded = F.try_validate_utf8(raw.cast("string"))
    return F.when(~decoded.contains("\u0000"), F.regexp_replace(decoded, "^﻿", ""))


def profile_files(members: DataFrame) -> DataFrame:
    """(analysis_id, path, content, ord, …) to file records: redacted text, language, line count, hash."""
    masked = members.withColumn("_masked", text.redact(F.col("content")))
    return (masked.withColumn("redacted", F.col("_masked") != F.col("content"))
            .withColumn("content", F.col("_masked")).drop("_masked")
            .withColumn("file_id", F.concat(F.lit("file:"), "path"))
            .withColumn("language", paths.language_of(F.col("path")))
            .withColumn("line_count", text.newline_count(F.col("content")) + 1)
            .withColumn("content_hash", F.sha2("content", 256)))


def archive_members(listing: DataFrame, max_entries: int = schemas.MAX_ENTRIES,
                    max_expanded: int = schemas.MAX_EXPANDED_BYTES, max_file: int = schemas.MAX_FILE_BYTES,
                    block: int = 65536) -> DataFrame:
    """Judge the member listings of many archives.

    listing: archive, seq (unique integer in listing order), name, type ('file', 'dir', other), size. Each row gets a
    ``verdict``: 'accept', 'skip' (not wanted), 'oversized' (warned and skipped) or 'reject:<reason>' for what makes the
    whole archive unacceptable.
    """
    is_file = F.col("type") == "file"
    marked = listing.withColumn("path", clean_member(F.col("name")))
    wanted = is_file & F.col("path").isNotNull() & paths.is_eligible(F.coalesce(F.col("path"), F.lit("")))
    marked = marked.withColumn("_wanted", wanted)
    totals = prefix.running_totals(marked, ["archive"], "seq", {
        "entries": F.lit(1).cast("long"),
        "expanded": F.when(is_file, F.col("size")).otherwise(F.lit(0)).cast("long")}, block)
    first = (marked.where("_wanted").groupBy("archive", "path").agg(F.min("seq").alias("_first")))
    judged = totals.join(first, ["archive", "path"], "left")
    verdict = (F.when(F.col("entries") > max_entries, "reject:entries")
               .when(unsafe_member(F.col("name")), "reject:path")
               .when(~F.col("type").isin("file", "dir"), "reject:link")
               .when(F.col("type") == "dir", "skip")
               .when(F.col("expanded") > max_expanded, "reject:expanded")
               .when(~F.col("_wanted"), "skip")
               .when(F.col("seq") > F.col("_first"), "reject:duplicate")
               .when(F.col("size") > max_file, "oversized").otherwise("accept"))
    return judged.withColumn("verdict", verdict).select(*listing.columns, "path", "entries", "expanded", "verdict")


def snapshot_limits(files: DataFrame) -> DataFrame:
    """Per snapshot: kept files and bytes, oversized files set aside, and the first limit passed."""
    size = F.octet_length("content")
    small = size <= schemas.MAX_FILE_BYTES
    totals = files.groupBy("analysis_id").agg(
        F.sum(small.cast("long")).alias("files"),
        F.sum(F.when(small, size).otherwise(0)).cast("long").alias("text_bytes"),
        F.sum((~small).cast("long")).alias("oversized"))
    reason = (F.when(F.col("files") > schemas.MAX_FILES, "files")
              .when(F.col("text_bytes") > schemas.MAX_TEXT_BYTES, "text_bytes"))
    return totals.withColumn("over_limit", reason)


def oversized_in(spark: SparkSession, root: str, analysis_id: str, max_file: int = schemas.MAX_FILE_BYTES) -> DataFrame:
    """A warning row for each eligible file below a folder that is larger than ``max_file`` bytes; contents are not read."""
    base = root.rstrip("/") + "/"
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
              .select(F.regexp_replace("path", "^file:/+", "/").alias("full"), "length"))
    relative = listed.withColumn("path", F.substring("full", F.lit(len(base) + 1), F.length("full")))
    return relative.where(paths.is_eligible(F.col("path")) & (F.col("length") > max_file)).select(
        F.lit(analysis_id).alias("analysis_id"), F.concat(F.lit("Too large and left out: "), "path").alias("warning"))

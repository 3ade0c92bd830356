"""Exact duplicates against immutable snapshots, screened by static binary-fuse filters.

A corpus grows by batches. Each older batch is an immutable snapshot: a table of its distinct digests, cut into shards by
digest, with one binary-fuse filter per shard. A new batch is first grouped by itself. Its digests then pass the filters of
every snapshot; what a filter rejects is new for certain and never meets the snapshot's table. What passes joins the exact
bucket of its digest, and equal digests are confirmed by comparing the texts byte for byte.

Texts are equal when they are identical after lower-casing A-Z. Of equal texts the row with the largest doc_id stays.

Results for odd input: null text is an empty text, and empty texts are equal to one another; a null doc_id stands below all
others, and a group in which all are null keeps null; identical (doc_id, text) rows count as that many members, of which one stays; an empty table or snapshot
gives no rows; columns besides doc_id and text are not read.
"""
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from codestrata.llm.common import cut_lineage, utf8

SHARD_DIGESTS = 400_000        # digests to a filter, some 450 KB of fingerprints


# The filter: three positions in neighbouring segments for each key; the fingerprints there xor to the key's own.

def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64(seed)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class BinaryFuseFilter:
    """A static set of 64-bit keys: never denies a member, accepts about one stranger in 256, some 9 bits a key."""

    def __init__(self, seed: int, segment: int, segments: int, fingerprints: np.ndarray):
        self.seed, self.segment, self.segments, self.fingerprints = seed, segment, segments, fingerprints

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = _mixed(keys, self.seed)
        two = _mixed(one, 0x9E3779B97F4A7C15)
        first = ((one >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)
        inside = [(two >> np.uint64(shift)) & np.uint64(self.segment - 1) for shift in (0, 21, 42)]
        places = [((first + np.uint64(i)) * np.uint64(self.segment) + inside[i]).astype(np.int64) for i in range(3)]
        return np.stack(places), (one & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuseFilter":
        keys = np.unique(np.asarray(keys, np.uint64))
        number = max(1, len(keys))
        segment = 1 << max(2, min(18, int(np.log(number) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(2, number)))
        segments = max(1, -(-int(number * factor) // segment) - 2)
        for seed in range(1, 200):
            made = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if made._fill(keys):
                return made
            if seed % 10 == 0:
                segments = segments * 11 // 10 + 1
        raise RuntimeError("no filter found for these keys")

    def _fill(self, keys: np.ndarray) -> bool:
        """Take away, round by round, keys that are alone in some place; then set places in the opposite order."""
        places, own = self._places(keys)
        size = len(self.fingerprints)
        load, index = np.zeros(size, np.int32), np.zeros(size, np.int64)
        for row in places:
            np.add.at(load, row, 1)
            np.add.at(index, row, np.arange(len(keys)))
        rounds, look = [], np.flatnonzero(load == 1)
        left = len(keys)
        while len(look):
            found, first = np.unique(index[look], return_index=True)
            rounds.append((found, look[first]))
            left -= len(found)
            touched = places[:, found]
            for row in touched:
                np.subtract.at(load, row, 1)
                np.subtract.at(index, row, found)
            touched = np.unique(touched)
            look = touched[load[touched] == 1]
        if left:
            return False
        for found, place in reversed(rounds):
            self.fingerprints[place] = 0
            at = places[:, found]
            self.fingerprints[place] = own[found] ^ self.fingerprints[at[0]] ^ self.fingerprints[at[1]] ^ self.fingerprints[at[2]]
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, own = self._places(np.asarray(keys, np.uint64))
        return (self.fingerprints[at[0]] ^ self.fingerprints[at[1]] ^ self.fingerprints[at[2]]) == own


@F.pandas_udf(BinaryType())
def text_digest(texts: pd.Series) -> pd.Series:
    """SHA-256 of UTF-8 bytes after lower-casing A-Z, which is what ``lower`` does to bytes."""
    return pd.Series([hashlib.sha256(text.lower()).digest() for text in texts])


@F.pandas_udf(BinaryType())
def _lowered(texts: pd.Series) -> pd.Series:
    return pd.Series([text.lower() for text in texts])


def with_digest(docs: DataFrame, name: str = "digest") -> DataFrame:
    return docs.withColumn(name, text_digest(utf8("text")))


def _key() -> Column:
    """The first 64 bits of a digest."""
    return F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")


def build_filters(snapshots: DataFrame, shards: int) -> DataFrame:
    """One filter per snapshot and shard of (generation, digest) rows."""
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        made = BinaryFuseFilter.build(frame["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"snapshot": [frame["generation"].iloc[0]], "shard": [frame["shard"].iloc[0]], "seed": [made.seed],
                             "segment": [made.segment], "segments": [made.segments], "fingerprints": [made.fingerprints.tobytes()]})
    return snapshots.select("generation", F.pmod("key", F.lit(shards)).alias("shard"), "key").groupBy("generation", "shard").applyInPandas(
        build, "snapshot int, shard long, seed int, segment int, segments int, fingerprints binary")


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Incoming digests that a filter of an older snapshot does not reject: digest, snapshot."""
    def test(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = [rows.iloc[:0].assign(snapshot=0)[["digest", "snapshot"]]]
        for f in held.itertuples():
            known = BinaryFuseFilter(f.seed, f.segment, f.segments, np.frombuffer(f.fingerprints, np.uint8))
            later = rows[rows["generation"] > f.snapshot]
            if len(later):
                hit = later[known.contains(later["key"].to_numpy().view(np.uint64))]
                found.append(pd.DataFrame({"digest": hit["digest"], "snapshot": f.snapshot}))
        return pd.concat(found, ignore_index=True)
    rows = incoming.select("digest", "generation", F.pmod("key", F.lit(shards)).alias("shard"), "key")
    return rows.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(test, "digest binary, snapshot int")


def dedup(docs: DataFrame, generation: Column) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept.

    ``generation`` numbers the batches in order of arrival; every row belongs to one. Each batch is screened by the filters
    of all snapshots before it. Equal digests are then grouped by the text's bytes; only texts of suspected rows take part.
    Should one digest ever stand for two texts, the job stops with an error instead of dropping one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(generation, F.lit(0)).cast("int").alias("generation"),
                       utf8("text").alias("text"))
    held = cut_lineage(with_digest(rows).select("doc_id", "generation", "digest"))
    groups = cut_lineage(held.groupBy("generation", "digest").agg(F.count("*").alias("n")).withColumn("key", _key()))
    size = groups.agg(F.count("*").alias("n"), F.max("generation").alias("last")).first()
    shards = max(1, -(-size["n"] // SHARD_DIGESTS))
    filters = build_filters(groups.filter(F.col("generation") < (size["last"] or 0)), shards)
    passed = screen(groups.filter(F.col("generation") > 0), filters, shards)
    bucket = groups.select(F.col("generation").alias("snapshot"), "digest")
    across = passed.join(bucket, ["snapshot", "digest"]).select("digest")
    within = groups.filter("n > 1").select("digest")
    suspects = across.union(within).distinct()
    texts = with_digest(rows).select("digest", "doc_id", _lowered("text").alias("text")).join(suspects, "digest", "left_semi")
    equal = texts.groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    classes = equal.groupBy("digest").agg(
        F.when(F.count("*") > 1, F.raise_error(F.lit("one digest, two texts")).cast("long")).otherwise(F.first("group_size")).alias("group_size"),
        F.first("keep_id").alias("keep_id"))
    ties = held.groupBy("doc_id", "digest").count()
    found = ties.join(classes, "digest", "left")
    return found.select(
        "doc_id", "digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("_nth"),
    ).select("doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"))


def by_arrival(docs: DataFrame, batches: int) -> Column:
    """A generation from 0 to ``batches`` - 1 for every row: equal ranges of doc_id, older ids first; null ids come first."""
    ends = docs.agg(F.min(F.col("doc_id").cast("long")).alias("low"), F.max(F.col("doc_id").cast("long")).alias("high")).first()
    low, span = ends["low"] or 0, (ends["high"] or 0) - (ends["low"] or 0) + 1
    wide = lambda number: F.lit(str(number)).cast("decimal(38,0)")  # noqa: E731  ids of both signs may lie 2**64 apart
    past = F.col("doc_id").cast("long").cast("decimal(38,0)") - wide(low)
    return F.when(F.col("doc_id").isNotNull(), F.least(F.floor(past * F.lit(batches) / wide(span)), F.lit(batches - 1))).cast("int")


def keep_one(docs: DataFrame, batches: int = 4) -> DataFrame:
    """docs with all its columns, without the rows that ``dedup`` drops."""
    name = "_digest"
    while name in docs.columns:
        name += "_"
    found = cut_lineage(dedup(docs.select("doc_id", "text"), by_arrival(docs, batches)))
    decided = found.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    marked = with_digest(docs, name)
    same = (F.col(f"d.{name}") == F.col("k.digest")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    once = marked.alias("d").join(decided.filter("NOT kept OR n > 1").alias("k"), same, "left_anti")
    repeated = marked.alias("d").join(decided.filter("kept AND n > 1").alias("k"), same, "left_semi").dropDuplicates(["doc_id", name])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Exact Jaccard self-join of shingle sets, size-aware, with the groups that its links form.

Equal sets are one node. Two nodes link when threshold * union <= intersection. Small sets and large ones are joined in
different ways, and a cost model on the histogram of set sizes draws the boundary:

* A small set of n shingles needs c(n, m) shared shingles with one of m. It enumerates its subsets of that fixed size for
  every m it may link to; sets of sizes n and m link exactly if some subset key (n, m, subset) is common to both. All sets
  of a key are linked, so each is tied to the first set of either size and no pair is enumerated.
* Large sets, and small ones that may link to them, enter inverted lists with a prefix of their shingles, rarest first; a
  link always shares a shingle of both prefixes. Which shingles are common comes from a bounded sample of documents; that only
  orders, so its errors cost time and never a link.

Lists are scanned where they meet, in one pass per bucket of shingles; what stays are the postings of shingles that two nodes
of sizes that can link share. Every member is first checked against the list's most central member, the one that meets most others on all its
lists, which among near copies is the original. Checked links form components, and only lists on which several components
still meet are scanned again: first between one member of each component, and at last over their pairs of different
components. So a group of copies costs its size and not its square, and no link between components is lost.

That last join is a prefix filter once more, now over the lists whose lengths are known: a linked pair of sizes n and m shares c
of its shingles on open lists, so with these ordered by the length of their lists it meets already on the first t - c + 1 of
either node's t. Shingles that the sample took for rare and that the whole corpus shares come last there.

Results for odd input: null text is an empty text; texts without words have an empty set, which links with nothing; a text
with fewer words than a shingle has its whole word sequence as its one shingle; documents with equal sets link; rows with
one doc_id are separate rows in ``groups``, and ``keep_one`` decides for each doc_id and set; a null doc_id is never a
component's name unless all its doc_ids are null; an empty table gives no rows; columns besides doc_id and text are not read.
"""
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage, giving_back, utf8, utf8_slices
from codestrata.llm.components import components
from codestrata.llm.shingles import mixed, shingle_set

THRESHOLD = (3, 4)             # numerator, denominator
SAMPLE_DOCUMENTS = 20_000      # documents from which common shingles are told
COMMON_SHINGLES = 1 << 18      # that many of them at most
BUCKET_POSTINGS = 2_000_000
BITMAP_BITS = 1 << 26
CHUNK_POSTINGS = 250_000       # postings a bucket's task takes up at once
LIST_COST = 4                  # what one posting costs against one subset key
LARGEST_SMALL = 12             # the boundary is sought up to this size
Common = tuple[np.ndarray, np.ndarray]      # sorted shingles and their levels


def needed(n: int, m: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """Least intersection of linked sets of n and m shingles."""
    p, q = threshold
    return -(-p * (n + m) // (p + q))


def partners(n: int, threshold: tuple[int, int] = THRESHOLD) -> range:
    """Sizes that a set of n shingles may link to."""
    p, q = threshold
    return range(-(-p * n // q), q * n // p + 1)


def prefix_length(n: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    return n - -(-threshold[0] * n // threshold[1]) + 1


def subset_keys(n: int, most: int) -> int:
    return sum(comb(n, min(n, needed(n, m))) for m in partners(n) if m <= most)


def boundary(histogram: dict[int, int]) -> int:
    """The largest size that enumerates subsets: the one of least estimated cost."""
    def cost(x: int) -> float:
        small = sum(histogram.get(n, 0) * subset_keys(n, x) for n in range(1, x + 1))
        listed = sum(number * prefix_length(n) * LIST_COST for n, number in histogram.items() if n > x or n in _crossing(x))
        return small + listed
    return min(range(LARGEST_SMALL + 1), key=lambda x: (cost(x), x))


def _crossing(x: int) -> set[int]:
    """Small sizes that may link to a large one."""
    return {n for n in range(1, x + 1) if partners(n).stop - 1 > x}


def _subset_tokens(members: np.ndarray, most: int) -> np.ndarray:
    """Keys of the subsets of a small set: (key, 1 if the set has the larger of the two sizes)."""
    n, keys, larger = len(members), [], []
    for m in partners(n):
        if m > most:
            continue
        c, low, high = needed(n, m), min(n, m), max(n, m)
        salt = mixed(np.array([(low << 20) + high], np.uint64))[0]
        chosen = np.array(list(combinations(range(n), c)), np.int64)
        total = mixed(members)[chosen].sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt
        keys.append(mixed(total))
        larger.append(np.full(len(chosen), n > m))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def node_of(members: np.ndarray) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(members.tobytes()) & 0x7FFFFFFFFFFFFFFF


def sizes_of(docs: DataFrame) -> tuple[DataFrame, Common]:
    """One pass: (doc_id, node, n) of every document as a written table, and which shingles are common.

    Shingles are counted in at most ``SAMPLE_DOCUMENTS`` documents, drawn by the hash of their set; those met at least twice,
    ``COMMON_SHINGLES`` at most, get the logarithm of their count as their level, all others are rare. The levels only order
    a document's shingles, so what the sample misses costs time and never a link.
    """
    share = SAMPLE_DOCUMENTS / max(1, docs.count())
    limit = np.uint64(min(share, 1.0) * 0xFFFFFFFF)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("shingle", pa.int64())])
        for some in utf8_slices(batches):
            nodes, sizes, drawn = [], [], [np.zeros(0, np.uint64)]
            for text in some.column(1).to_pylist():
                members = shingle_set(text)
                nodes.append(node_of(members) if len(members) else None)
                sizes.append(len(members))
                if len(members) and mixed(np.array([nodes[-1]], np.uint64))[0] & np.uint64(0xFFFFFFFF) <= limit:
                    drawn.append(members)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(sizes), pa.int64())], schema=kinds)
            met, times = np.unique(np.concatenate(drawn), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(met), pa.int64()), pa.nulls(len(met), pa.int64()), pa.array(-times), pa.array(met.view(np.int64))], schema=kinds)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    made = cut_lineage(rows.mapInArrow(giving_back(sets), "doc_id long, node long, n long, shingle long"))
    counts = made.filter("n < 0").groupBy("shingle").agg((-F.sum("n")).alias("times")).filter("times > 1")
    most = counts.orderBy(F.desc("times"), "shingle").limit(COMMON_SHINGLES).toArrow()           # at most COMMON_SHINGLES rows
    shingles = most.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    levels = np.log2(most.column("times").to_numpy().astype(np.float64))[order].astype(np.uint8)
    return made.filter("n >= 0").select("doc_id", "node", "n"), (shingles[order], levels)


def level_of(members: np.ndarray, common: Common) -> np.ndarray:
    """How common each shingle is; 0 for all that the sample met once or never."""
    shingles, levels = common
    if not len(shingles):
        return np.zeros(len(members), np.uint8)
    at = np.minimum(np.searchsorted(shingles, members), len(shingles) - 1)
    return np.where(shingles[at] == members, levels[at], np.uint8(0))


def _needed(n: Column, m: Column, threshold: tuple[int, int] = THRESHOLD) -> Column:
    p, q = threshold
    return F.ceil(p * (n + m) / (p + q))


def common_needed(n: Column, m: Column, threshold: tuple[int, int] = THRESHOLD) -> Column:
    """Least number of shingles that the prefixes of a linked pair share: what the intersection needs beyond the larger
    set's suffix. The prefix that ends first in the common order lies, as far as it is shared, wholly in the other."""
    p, q = threshold
    return _needed(n, m) - F.ceil(p * F.greatest(n, m) / q) + 1


def postings(docs: DataFrame, common: Common, small: int, buckets: int) -> DataFrame:
    """Packed (token, node, n with the place in the prefix) triples by bucket: prefixes of large sets and of small ones near the boundary, and subset keys.

    Subset keys carry -n, so that a list knows them: their lists are complete once tied to the first set of each size.
    """
    crossing = _crossing(small)
    sent = docs.sparkSession.sparkContext.broadcast(common)       # nine bytes for each of COMMON_SHINGLES at most

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for some in utf8_slices(batches):
            tokens, nodes, sizes = [], [], []
            for text in some.column(0).to_pylist():
                members = shingle_set(text)
                n = len(members)
                node = node_of(members) if n else None
                if not n or node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                found = []
                if n > small or n in crossing:
                    level = level_of(members, sent.value)
                    found.append((members[np.argsort(level, kind="stable")[:prefix_length(n)]], n))
                if n <= small:
                    found.append((np.unique(_subset_tokens(members, small)), -n))
                for keys, size in found:
                    tokens.append(keys)
                    nodes.append(np.full(len(keys), node, np.int64))
                    sizes.append((size << 32) + np.arange(len(keys)))
            if not tokens:
                continue
            token, node, size = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes).astype(np.int64)
            bucket = (mixed(token) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            token, node, size, bucket = token[order], node[order], size[order], bucket[order]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            parts = [[x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for x in (token, node, size)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), *[pa.array(p, pa.binary()) for p in parts]], ["bucket", "tokens", "nodes", "sizes"])
    return docs.select(utf8("text").alias("text")).mapInArrow(giving_back(packed), "bucket long, tokens binary, nodes binary, sizes binary")


def shared(packed: DataFrame, buckets: int) -> DataFrame:
    """Postings of tokens that two nodes share: token, node, n, place.

    A task takes its buckets in chunks and keeps one member of each list, the first, until a second comes; a list of any
    length streams by.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)]          # token, first node, its size and place
        waiting = np.zeros(0, bool)                                                # the first member is not written yet

        def take(token, node, size):
            nonlocal known, waiting
            order = np.lexsort((node, token))
            token, node, size = token[order], node[order], size[order]
            fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
            token, node, size = token[fresh], node[fresh], size[fresh]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.concatenate([start, [len(token)]]))
            at = np.searchsorted(known[0], token[start])
            old = np.zeros(len(start), bool)
            inside = at < len(known[0])
            old[inside] = known[0][at[inside]] == token[start][inside]
            first, first_size = node[start].copy(), size[start].copy()
            first[old], first_size[old] = known[1][at[old]], known[2][at[old]]
            rest = node != np.repeat(first, length)
            has_rest = np.add.reduceat(rest.astype(np.int64), start) > 0
            # The first member is written when its list gets a second one.
            due = has_rest & ~old
            late = old & has_rest
            late[late] = waiting[at[late]]
            waiting[at[late]] = False
            lead = due | late
            out = [np.concatenate(c) for c in ((token[rest], token[start][lead]), (node[rest], first[lead]), (size[rest], first_size[lead]))]
            new = ~old
            keys = np.concatenate([known[0], token[start][new]])
            order = np.argsort(keys, kind="stable")
            known = [keys[order], np.concatenate([known[1], first[new]])[order], np.concatenate([known[2], first_size[new]])[order]]
            waiting = np.concatenate([waiting, ~has_rest[new]])[order]
            return pa.RecordBatch.from_arrays([pa.array(out[0].view(np.int64)), pa.array(out[1]), pa.array(out[2] >> 32), pa.array(out[2] & 0xFFFFFFFF)], ["token", "node", "n", "place"])

        held, number = [], 0
        for batch in batches:
            for row in batch.select(["tokens", "nodes", "sizes"]).to_pylist():
                held.append((np.frombuffer(row["tokens"], np.uint64), np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["sizes"], np.int64)))
                number += len(held[-1][0])
                if number >= CHUNK_POSTINGS:
                    yield take(*map(np.concatenate, zip(*held, strict=True)))
                    held, number = [], 0
        if held:
            yield take(*map(np.concatenate, zip(*held, strict=True)))
    return packed.repartition(buckets, "bucket").mapInArrow(giving_back(scan), "token long, node long, n long, place long")


def sets_of(docs: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its sorted shingles for the wanted nodes, from one document of each node.

    Texts do not move: a bitmap of the wanted documents' hashes, of at most ``BITMAP_BITS`` bits, goes to the scan. What
    passes it by chance is dropped by the join with the wanted ones.
    """
    wanted = cut_lineage(known.join(nodes.select("node").distinct(), "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    bits = 1 << 16
    while bits < min(BITMAP_BITS, 32 * wanted.count()):
        bits *= 2
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = wanted.select(F.floor(place / 64).alias("word"), F.expr("shiftleft(1L, cast({} % 64 as int))".format(f"pmod(xxhash64(doc_id), {bits}L)")).alias("bit"))
    bitmap = np.zeros(bits // 64, np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():     # at most BITMAP_BITS / 64 rows
        bitmap[row["word"]] = row["bits"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(bitmap.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            for some in utf8_slices([batch.filter(pa.array(flags[batch.column(0).to_numpy()]))]):
                found = [shingle_set(text) for text in some.column(2).to_pylist()]
                rows = [(node_of(members), doc_id, members.tobytes()) for members, doc_id in zip(found, some.column(1).to_pylist(), strict=True) if len(members)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["node", "doc_id", "members"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).select(place.alias("place"), "doc_id", "text")
    made = rows.mapInArrow(giving_back(sets), "node long, doc_id long, members binary")
    chosen = wanted.select("node", F.col("doc_id").alias("d"))
    return cut_lineage(made.join(chosen, "node").filter(F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "members"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of nodes that link: q * intersection >= p * union."""
    p, q = threshold

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(q * common >= p * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(giving_back(check), "a long, b long").distinct()


def _near(a: str, b: str, threshold: tuple[int, int] = THRESHOLD):
    p, q = threshold
    return (F.col(a) * q >= F.col(b) * p) & (F.col(b) * q >= F.col(a) * p)


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def near_on_lists(lists: DataFrame) -> DataFrame:
    """The postings, once each, of members with another on their list whose size lets them link; lists of equal members are
    one, with their number as its ``weight``, a member's first place on them, and the number of members as its length.

    A linked pair keeps all the lists that it shares. Lists are told apart by a hash of their members; two that fell together
    would only bring more pairs to be checked.
    """
    p, q = THRESHOLD
    by_size = Window.partitionBy("token").orderBy("n", "node")
    once = lists.withColumn("last", F.lag("node").over(by_size)).filter("last IS NULL OR last <> node").drop("last")
    sized = once.withColumn("below", F.lag("n").over(by_size)).withColumn("above", F.lead("n").over(by_size))
    near = sized.filter((F.col("below") * q >= F.col("n") * p) | (F.col("n") * q >= F.col("above") * p)).drop("below", "above")
    of_list = Window.partitionBy("token")
    near = near.withColumn("length", F.count("*").over(of_list)).withColumn("members", F.bit_xor(F.xxhash64("node")).over(of_list))
    near = near.select("node", "n", "place", "length", F.xxhash64("length", "members").alias("token"))
    return near.repartition("node").groupBy("node", "n", "token", "length").agg(F.count("*").alias("weight"), F.min("place").alias("place"))


def meeting_pairs(rows: DataFrame) -> DataFrame:
    """(node, other) of every pair of different components that may link. rows: list, node, n, first place on the list,
    component, and of the node's ``tokens`` shingles the ``rank`` of the list's first by the lengths of lists.

    A linked pair shares c = ``common_needed`` shingles within the places that reach them (n less the larger set's suffix). The
    first of these by rank has c - 1 others behind it in either node, so its list is met on both sides.
    """
    p, q = THRESHOLD
    partner = rows.select("token", F.col("node").alias("other"), F.col("n").alias("m"), F.col("component").alias("c"), F.col("place").alias("place_m"),
                          F.col("rank").alias("rank_m"), F.col("tokens").alias("tokens_m"))
    common, tail = common_needed(F.col("n"), F.col("m")), F.ceil(p * F.greatest("n", "m") / q)
    reach = (F.col("place") <= F.col("n") - tail) & (F.col("place_m") <= F.col("m") - tail)
    ranks = (F.col("rank") <= F.col("tokens") - common + 1) & (F.col("rank_m") <= F.col("tokens_m") - common + 1)
    return rows.join(partner, (rows["token"] == partner["token"]) & (F.col("component") < F.col("c")) & _near("n", "m") & reach & ranks).select("node", "other")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents as doc_id, node, n; components as node, component of the nodes that link to another)."""
    spark = docs.sparkSession
    known, common = sizes_of(docs)
    total = known.agg(F.sum("n")).first()[0] or 0
    sizes = known.filter(F.col("n").between(1, 2 * LARGEST_SMALL)).groupBy("n").agg(F.approx_count_distinct("node").alias("c"))
    small = boundary({r["n"]: r["c"] for r in sizes.collect()})
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (3 * BUCKET_POSTINGS) + 1)
    lists = shared(postings(docs, common, small, buckets), buckets).withColumn("subset", F.col("n") < 0)
    lists = cut_lineage(lists.withColumn("n", F.abs("n")))
    plain = near_on_lists(lists.filter("NOT subset").drop("subset"))
    needs = common_needed(F.col("n"), F.col("m"))

    # Each member against the most central one of its list, if they meet on a fair part of the lists that a link needs.
    of_list, of_node = Window.partitionBy("token"), Window.partitionBy("node")       # a node has no more rows than its prefix
    plain = plain.withColumn("central", F.sum(F.col("length") * F.col("weight")).over(of_node)).drop("length")
    plain = plain.withColumn("lead", F.max(F.struct("central", "node", "n")).over(of_list))
    plain = cut_lineage(plain.select("token", "node", "n", "place", "weight", "central", F.col("lead.node").alias("lead"), F.col("lead.n").alias("m")))
    ties = plain.filter((F.col("node") != F.col("lead")) & _near("n", "m")).groupBy("node", "lead", "n", "m").agg(F.sum("weight").alias("common"))
    first = ties.filter(F.col("common") * 4 >= needs).select(*_pair("node", "lead"))
    # A subset list ties each set to one of the other size, or to its first set where only one size has come.
    keyed = lists.filter("subset").select("token", "node", "n")
    ends = keyed.groupBy("token").agg(F.min(F.struct("n", "node")).alias("low"), F.max(F.struct("n", "node")).alias("high"))
    other = F.when(F.col("n") == F.col("low.n"), F.when(F.col("low.n") == F.col("high.n"), F.col("low")).otherwise(F.col("high"))).otherwise(F.col("low"))
    by_subset = keyed.join(ends, "token").withColumn("other", other).select("node", F.col("other.node").alias("other"), "n", F.col("other.n").alias("m"))
    pairs = cut_lineage(first.union(by_subset.filter("node <> other").filter(_near("n", "m")).select(*_pair("node", "other"))).distinct())
    sets = sets_of(docs, known, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
    held = cut_lineage(verified(pairs, sets))
    found = components(held)

    # Lists on which several components still meet.
    def still_open(rows: DataFrame) -> DataFrame:
        rows = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rows = rows.withColumn("low", F.min("component").over(of_list)).withColumn("high", F.max("component").over(of_list))
        return rows.filter("low < high").drop("low", "high")
    open_lists = plain.drop("lead", "m")
    for last in (False, True):
        if last:       # every pair of different components that shares what its sizes need
            rows = still_open(open_lists).withColumn("length", F.count("*").over(of_list))
            before = of_node.orderBy("length", "token").rowsBetween(Window.unboundedPreceding, -1)
            rows = rows.withColumn("rank", F.coalesce(F.sum("weight").over(before), F.lit(0)) + 1).withColumn("tokens", F.sum("weight").over(of_node))
            rows = cut_lineage(rows.select("token", "node", "n", "place", "component", "rank", "tokens"))
            met = meeting_pairs(rows)
        else:          # the most central member of each component with the most central of all
            rows = cut_lineage(still_open(open_lists))
            one_each = rows.groupBy("token", "component").agg(F.max(F.struct("central", "node", "n")).alias("one"), F.max("weight").alias("weight")).select("token", "component", "weight", "one.*")
            met = one_each.withColumn("top", F.max(F.struct("central", "node", "n", "component")).over(of_list)).select(
                "node", "n", "component", "weight", F.col("top.node").alias("other"), F.col("top.n").alias("m"), F.col("top.component").alias("c"))
            met = met.filter(F.col("component") != F.col("c")).filter(_near("n", "m")).groupBy("node", "other", "n", "m").agg(F.sum("weight").alias("common"))
            met = met.filter(F.col("common") * 4 >= needs)
            open_lists = rows.drop("component")
        more = cut_lineage(met.select(*_pair("node", "other")).distinct().join(pairs, ["a", "b"], "left_anti"))
        nodes = more.select(F.col("a").alias("node")).union(more.select(F.col("b").alias("node")))
        pairs = pairs.unionByName(more)
        held = held.unionByName(cut_lineage(verified(more, sets_of(docs, known, nodes))))
        found = components(held)
    return known, found


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included)."""
    known, found = links(docs)
    least = known.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left")
    least = least.withColumn("component", F.coalesce("component", "node"))
    named = least.groupBy("component").agg(F.min("least").alias("component_id"))
    names = least.join(named, "component").select("node", "component_id")
    return known.join(names, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def with_node(docs: DataFrame, name: str) -> DataFrame:
    """docs with the node of each text's shingle set in a new column ``name``; null for texts without words."""
    @F.pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        sets = (shingle_set(text) for text in texts)
        return pd.Series([node_of(s) if len(s) else None for s in sets], dtype="Int64")
    return docs.withColumn(name, node(utf8("text")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with all columns; one row of each group: of the rows with the smallest known doc_id, the one of the smallest node.

    Rows are told apart by doc_id and shingle set, so an id that stands for several texts is decided for each of them; of rows
    equal in both one stays. Where all ids of a group are null, a row of the smallest node stays. Texts without words stay.
    """
    known, found = links(docs)
    members = known.filter("node IS NOT NULL").groupBy("doc_id", "node").agg(F.count("*").alias("rows")).join(found, "node", "left")
    members = cut_lineage(members.withColumn("component", F.coalesce("component", "node")))
    first = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "node")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    decided = members.join(first, "component").select(F.col("doc_id").alias("_d"), F.col("node").alias("_n"), "rows", stays.alias("stays"))
    name = "_node"
    while name in docs.columns:
        name += "_"
    marked = with_node(docs, name)
    marked, same = marked.alias("m"), F.col("m.doc_id").eqNullSafe(F.col("k._d")) & (F.col(f"m.{name}") == F.col("k._n"))
    once = marked.join(decided.filter("NOT stays OR rows > 1").alias("k"), same, "left_anti")
    repeated = marked.join(decided.filter("stays AND rows > 1").alias("k"), same, "left_semi").dropDuplicates(["doc_id", name])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])

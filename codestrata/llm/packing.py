"""Best-fit packing of documents into training sequences by bin completion.

What a packing needs of the corpus is how many pieces there are of each length, and there are at most ``capacity`` lengths.
Spark tokenizes, counts the lengths, ranks the pieces of each length and places them; the branch and bound works on the
counts, a table whose size does not grow with the corpus, so the packing is one global solution at any scale.

Results for odd input: null text is an empty text, an empty text is one piece that holds only the end id; null or repeated
doc_ids are packed like others; an empty table gives an empty result; columns besides doc_id and text are not read.
"""
import heapq
import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage, giving_back, utf8, utf8_slices
from codestrata.llm.tokens import encoder

Filling = tuple[tuple[int, int], ...]            # (length, times), longest first
RANKED_TOGETHER = 200_000                        # pieces of one length ranked by one task
log = logging.getLogger(__name__)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenize whole texts, append ``end_id`` and cut only what is longer than ``capacity``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for some in utf8_slices(batches, 2 << 20):
            rows = []
            for doc_id, ids in zip(some.column(0).to_pylist(), words.encode(some.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).mapInArrow(
        giving_back(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray) -> int:
    """No packing has fewer bins: for each k, items above C-k stand alone, those above C/2 pairwise apart, and what items
    of at least k do not find in the gaps of the latter needs bins of its own."""
    capacity = len(counts) - 1
    size = np.arange(capacity + 1, dtype=np.int64)
    number, volume = np.cumsum(counts), np.cumsum(counts * size)
    k = np.arange(capacity // 2 + 1)
    alone = number[-1] - number[capacity - k]
    half = capacity // 2
    apart = number[capacity - k] - number[half]
    gaps = apart * capacity - (volume[capacity - k] - volume[half])
    small = volume[half] - np.where(k > 0, volume[np.maximum(k - 1, 0)], 0)
    return int(np.max(alone + apart + np.maximum(0, -(-(small - gaps) // capacity)), initial=0))


def best_fit(counts: np.ndarray) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over whole lengths at once: equal bins are held as one group with a number."""
    counts, capacity = counts.copy(), len(counts) - 1
    open_bins: list[dict[Filling, int]] = [{} for _ in range(capacity + 1)]      # by room left
    full: dict[Filling, int] = {}
    room = np.zeros(capacity + 1, bool)

    def put(filling: Filling, number: int, left: int) -> None:
        where = open_bins[left] if left else full
        where[filling] = where.get(filling, 0) + number
        room[left] = left > 0

    for size in range(capacity, 0, -1):
        left_over = int(counts[size])
        while left_over:
            fits = np.flatnonzero(room[size:])
            if not len(fits):
                each = min(capacity // size, left_over)
                number = left_over // each
                put(((size, each),), number, capacity - size * each)
                left_over -= number * each
                continue
            at = size + int(fits[0])
            filling, number = next(iter(open_bins[at].items()))
            take = min(number, left_over)
            if take == number:
                del open_bins[at][filling]
                room[at] = bool(open_bins[at])
            else:
                open_bins[at][filling] = number - take
            last, times = filling[-1]
            grown = (*filling[:-1], (last, times + 1)) if last == size else (*filling, (size, 1))
            put(grown, take, at - size)
            left_over -= take
    return [*full.items(), *(item for group in open_bins for item in group.items())]


def _undominated(counts: np.ndarray, room: int, most: int, keep: int, effort: int) -> tuple[list[tuple[int, Filling]], bool]:
    """The first ``keep`` fillings of ``room`` from the lengths left, by waste, and whether these are all; a filling
    of which one item could be swapped for a longer one that is left and fits is dominated and not returned. The search goes from long items to short ones, and a branch ends
    when even the items below cannot bring its waste under that of the fillings kept."""
    sizes = np.flatnonzero(counts[:min(room, most) + 1])
    found: list[tuple[int, Filling]] = []
    whole = True
    volume = np.concatenate([[0], np.cumsum(sizes * counts[sizes])])
    steps = 0

    def worst() -> int:
        return found[-1][0] if len(found) >= keep else room + 1

    def search(left: int, below: int, chosen: tuple[tuple[int, int], ...]) -> None:
        nonlocal steps, whole
        steps += 1
        top = min(below, int(np.searchsorted(sizes, left, "right")))
        if top == 0 or left == 0:
            used = dict(chosen)
            for size, times in chosen:
                longer = sizes[np.searchsorted(sizes, size, "right"):np.searchsorted(sizes, size + left, "right")]
                if any(counts[b] > used.get(int(b), 0) for b in longer):
                    return
            found.append((left, chosen))
            found.sort(key=lambda f: f[0])
            whole = whole and len(found) <= keep
            del found[keep:]
            return
        for at in range(top - 1, -1, -1):
            if steps > effort and found or (found and found[0][0] == 0 and len(found) >= keep):
                whole = False
                return
            if left - int(volume[at + 1]) >= worst():     # all that is left from here down wastes more
                whole = False
                return
            size = int(sizes[at])
            for times in range(min(left // size, int(counts[size])), 0, -1):
                search(left - times * size, at, (*chosen, (size, times)))
                if found and found[0][0] == 0 and len(found) >= keep:
                    whole = False
                    return

    search(room, len(sizes), ())
    return found or [(room, ())], whole


WIDER = 4                      # a node that comes up again lists so many times as many fillings


def search_nodes(counts: np.ndarray) -> int:
    """Nodes that bin_completion may expand: a descent exhausts a length or two at a node, so this holds several."""
    return 1000 + 4 * int(np.count_nonzero(counts))


def bin_completion(counts: np.ndarray, branches: int = 3, effort: int = 400, nodes: int | None = None) -> list[tuple[Filling, int]]:
    """Fillings with how often each is used, over ``counts[length]`` items.

    Always completes the bin of the longest item left. Its fillings are ordered by waste; a filling is used as often as the
    counts allow. A branch ends when its waste exceeds what a packing with one bin less than the incumbent may waste. The
    first incumbent is best-fit decreasing.

    A node first lists ``branches`` fillings. While there are more, the node itself waits as one more alternative, to list
    WIDER times as many; using a filling once instead of as often as the counts allow is an alternative too. So nothing is
    lost to the search but by ``nodes``.

    The search is by limited discrepancy: it descends by the fillings of least waste, then starts anew from the alternatives
    that leave such descents least often, in turn from the one nearest the root and from the one farthest. Every node
    expanded counts against ``nodes``, with a longer list as often as that is longer; a search that ends so leaves out no item, and the log tells bins and lower bound.
    """
    counts = np.asarray(counts, dtype=np.int64)
    capacity, total = len(counts) - 1, int((counts * np.arange(len(counts))).sum())
    incumbent = best_fit(counts)
    bins, bound = sum(n for _, n in incumbent), lower_bound(counts)
    budget = rest = search_nodes(counts) if nodes is None else nodes
    # A node is (parent, filling, times, bins used, waste, depth, discrepancies, how often its list was made longer, fillings
    # dealt with by then); the counts left are kept for one node and replayed for another.
    root = (None, (), 0, 0, 0, 0, 0, 0, frozenset())
    node, at, left = root, root, counts.copy()
    near, far, waiting = [], [], {}                  # heaps of (discrepancies, depth or its negative, number) of waiting nodes
    number = turn = 0
    while bins > bound and rest:
        if node is None:
            heap, turn = (near, far)[turn], 1 - turn
            while heap and heap[0][2] not in waiting:
                heapq.heappop(heap)
            if not heap:                              # both hold the same nodes
                break
            node = waiting.pop(heapq.heappop(heap)[2])
        parent, filling, times, used, waste, depth, apart, widened, dealt = node
        if waste > (bins - 1) * capacity - total:
            node = None
            continue
        wider = WIDER ** widened
        rest = max(0, rest - wider)
        if parent is at:
            for size, need in filling:
                left[size] -= need * times
        elif node is not root:
            left, above = counts.copy(), node
            while above[0] is not None:
                for size, need in above[1]:
                    left[size] -= need * above[2]
                above = above[0]
        at = node
        there = np.flatnonzero(left)
        if not len(there):
            incumbent, bins, above = [], used, node
            while above[0] is not None:
                incumbent.append((above[1], above[2]))
                above = above[0]
            node = None
            continue
        longest = int(there[-1])
        left[longest] -= 1
        options, whole = _undominated(left, capacity - longest, longest, branches * wider, effort * wider) if longest < capacity else ([(0, ())], True)
        left[longest] += 1
        if not whole:                                 # the same node with a longer list is one more alternative
            number += 1
            waiting[number] = (parent, filling, times, used, waste, depth, apart, widened + 1, dealt.union(others for _, others in options))
            heapq.heappush(near, (apart + len(options), depth, number))
            heapq.heappush(far, (apart + len(options), -depth, number))
        node = None
        for rank, (lost, others) in enumerate(options):
            if others in dealt:
                continue
            merged = {longest: 1}
            for size, need in others:
                merged[size] = merged.get(size, 0) + need
            times = min(int(left[size]) // need for size, need in merged.items())
            made = tuple(sorted(merged.items(), reverse=True))
            child = (at, made, times, used + times, waste + lost * times, depth + 1, apart + rank, 0, frozenset())
            if times > 1:
                number += 1
                waiting[number] = (at, made, 1, used + 1, waste + lost, depth + 1, apart + rank + 1, 0, frozenset())
                heapq.heappush(near, (apart + rank + 1, depth, number))
                heapq.heappush(far, (apart + rank + 1, -depth, number))
            if node is None:
                node = child
            else:
                number += 1
                waiting[number] = child
                heapq.heappush(near, (apart + rank, depth, number))
                heapq.heappush(far, (apart + rank, -depth, number))
    log.log(logging.WARNING if bins > bound else logging.INFO, "packing of %d lengths: %d bins, lower bound %d, %d of %d nodes",
            np.count_nonzero(counts), bins, bound, budget - rest, budget)
    return incumbent


def _slots(plan: list[tuple[Filling, int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, items per sequence and offset in the sequence, of each run of equal fillings."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = [0] * (capacity + 1), 0
    for filling, number in plan:
        offset = 0
        for size, times in filling:
            runs.setdefault(size, []).append((taken[size], sequence, times, offset))
            taken[size] += times * number
            offset += size * times
        sequence += number
    return {size: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for size, rows in runs.items()}


def pack(pieces: DataFrame, capacity: int, branches: int = 3, effort: int = 400, nodes: int | None = None) -> DataFrame:
    """Add sequence_id and offset to a table with a column ``length`` (1 to ``capacity``), in as few sequences as it can.
    ``branches``, ``effort`` and ``nodes`` are those of ``bin_completion``.

    Pieces of one length are alike, so each gets a rank among them and the rank decides its place. Ranks are counted in
    slices; the more pieces a length has, the more slices, so a length that a third of all pieces share is no hot group.
    """
    spark = pieces.sparkSession
    held = cut_lineage(pieces)
    counts = np.zeros(capacity + 1, np.int64)
    for row in held.groupBy("length").count().collect():          # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    slots = _slots(bin_completion(counts, branches, effort, nodes), capacity)
    # At most ``capacity`` rows.
    lengths = spark.createDataFrame([(int(n), int(-(-counts[n] // RANKED_TOGETHER))) for n in np.flatnonzero(counts)],
                                    "length long, _slices long")
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in held.columns])
    sliced = held.join(F.broadcast(lengths), "length").withColumn("_spread", spread).withColumn("_slice", F.pmod(F.col("_spread"), F.col("_slices")))
    keys = ["length", "_slice"]
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy(*keys).count().select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first")).repartition(*keys)
    inside = Window.partitionBy(*keys).orderBy("_spread", *[F.col(f"`{c}`") for c in held.columns if c != "length"])
    ranked = sliced.withColumn("_rank", F.row_number().over(inside)).join(starts, keys).select(
        *[F.col(f"`{c}`") for c in held.columns], (F.col("_first") + F.col("_rank") - 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank, length = frame["sequence_id"].to_numpy(), frame["length"].to_numpy()
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, edges) if len(order) else []:
                size = int(length[rows[0]])
                first, bins, times, at = slots[size]
                run = np.searchsorted(first, rank[rows], "right") - 1
                past = rank[rows] - first[run]
                sequence[rows] = bins[run] + past // times[run]
                offset[rows] = at[run] + past % times[run] * size
            yield frame.assign(sequence_id=sequence, offset=offset)
    return ranked.mapInPandas(place, ranked.schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, **search: int) -> DataFrame:
    """Every piece of every document with its sequence and its place there; ``search``: as in ``pack``."""
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity, **search)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids, at most one sequence's worth of rows to a group.

    Texts are tokenized again rather than stored between; docs must have unique doc_ids here.
    """
    wanted = placed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for some in utf8_slices(batches, 2 << 20):
            rows = []
            for places, ids in zip(some.column(0).to_pylist(), words.encode(some.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(ids + end, "<u4")
                rows += [(p["sequence_id"], p["offset"], ids[p["start"]:p["start"] + p["length"]].tolist()) for p in places]
            yield pa.RecordBatch.from_pylist([dict(zip(("sequence_id", "offset", "ids"), r, strict=True)) for r in rows],
                                             pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int64()))]))
    found = docs.select("doc_id", utf8("text").alias("text")).join(wanted, "doc_id").select("places", "text").mapInArrow(
        parts, "sequence_id long, offset long, ids array<long>")
    return found.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))

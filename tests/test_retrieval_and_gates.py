"""Ranking, evidence, packing and gates against literal and brute-force results."""
import datetime as dt
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.functions.clock import pacific_reset_seconds, retry_after_seconds
from codestrata.operators import quality, retrieval
from codestrata.streaming import admission, jobs

BOILER, VALVE, POM, OTHER = ("heating/src/main/java/plant/BoilerControl.java", "heating/src/main/java/plant/ValveGuard.java", "heating/pom.xml", "Laundry/src/main/java/plant/LaundryGuard.java")
CHUNKS = {
    "burn": (BOILER, 20, 36, "Schedule burnPlan() { return plan.every(minutes(5)).whenColder(limit).then(burner::start).otherwise(burner::stop); }", "method", "burnPlan"),
    "limits": (BOILER, 4, 18, "Limits heatingLimits() { return Limits.of(celsius(5), celsius(80)).withAlarm(this::ring); }", "declarations", ""),
    "tiny": (BOILER, 41, 41, "}", "top-level", ""), "valve": (VALVE, 12, 60, "class ValveGuard { void check() { if (pressure.tooHigh()) { valve.open(); heating.pause(); } } }", "method", "check"),
    "valve-tiny": (VALVE, 70, 70, "}", "top-level", ""), "manifest": (POM, 1, 44, "<dependency>heating-sensors</dependency>", "top-level", ""),
    "unrelated": (OTHER, 8, 30, "class LaundryGuard { void check() { door.lock(); } }", "method", "check")}


def evidence(spark, question, selected, modules=("heating",)):
    ranked = lambda names: spark.createDataFrame([("q", n, i + 1) for i, n in enumerate(names)], "request_id string, chunk_id string, rank int")
    extra = spark.createDataFrame([("q", n) for n, c in CHUNKS.items() if c[0].split("/")[0] in modules], "request_id string, chunk_id string")
    fused = retrieval.fuse([ranked(["tiny", "valve-tiny", "manifest", "valve", "burn"]), ranked(["unrelated", "manifest", "valve"])], extra)
    rows = [(n, "file:" + c[0], *c, i) for i, (n, c) in enumerate(CHUNKS.items())]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_id string, path string, start_line int, end_line int, text string, kind string, symbol string, ord int")
    ready = fused.join(chunks, "chunk_id").selectExpr("*", f"'{question}' AS question", "split(path, '/')[0] IN ('heating') AS module_hit", "true AS any_module", f"path = '{selected}' AS selected", "false AS selection_named")
    scored = retrieval.boosted(ready)
    from pyspark.sql import Window
    placed = scored.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "ord")))
    return [r.chunk_id for r in retrieval.select_evidence(retrieval.diversify(placed)).orderBy("number").collect()]


def test_component_question_prefers_its_implementation(spark):
    ids = evidence(spark, "explain the heating", VALVE)
    assert {"burn", "valve"} <= set(ids[:3]) and "limits" in ids and not {"manifest", "tiny", "valve-tiny", "unrelated"} & set(ids)
    assert "manifest" in evidence(spark, "Which dependencies does the heating POM declare?", "")


def test_evidence_is_the_first_of_all_choices_that_keep_the_rules(spark):
    """Each chosen list is compared with a search: the smallest list of places to which no earlier candidate could be added."""
    rng = random.Random(8)
    rows = [(f"q{q}", i + 1, f"c{i}", f"f{rng.randrange(4)}", f"m/p{i}.py", s := rng.randrange(1, 40), s + rng.randrange(0, 15), "word " * rng.choice([3, 40, 900]),
             "plain question" if q % 2 else "what does this depend on", rng.random() < 0.6, q < 4, q == 1) for q in range(6) for i in range(25)]
    table = spark.createDataFrame(rows, "request_id string, place int, chunk_id string, file_id string, path string, start_line int, end_line int, text string, question string, module_hit boolean, "
                                        "any_module boolean, selection_named boolean")
    got = {}
    for r in retrieval.select_evidence(table, 9_000).orderBy("request_id", "number").collect():
        got.setdefault(r.request_id, []).append(r.chunk_id)

    def allowed(chosen, new):
        own = [c for c in chosen if c[3] == new[3]]
        lines = set(range(new[5], new[6] + 1))
        shown = lines & {n for c in own for n in range(c[5], c[6] + 1)}
        strangers = [c for c in chosen if c[10] and not c[9]]
        return (len(new[7].strip()) >= 20 and len(chosen) < 16 and sum(len(c[7]) + 150 for c in [*chosen, new]) <= 9_000 and len(own) < (3 if new[11] else 2)
                and (not new[10] or new[9] or len(strangers) < (2 if "depend" in new[8] else 0)) and len(shown) <= 0.7 * len(lines))
    for q, ids in got.items():
        mine = {r[2]: r for r in rows if r[0] == q}
        chosen = [mine[i] for i in ids]
        for r in mine.values():      # a candidate is chosen exactly if those chosen before it leave room for it
            before = [c for c in chosen if c[1] < r[1]]
            assert (r in chosen) == allowed(before, r), (q, r)


def test_follow_up_topic(spark):
    turns = [("user", "Where are orders stored?"), ("assistant", "In a table."), ("user", "tell me more"), ("assistant", "Soon."), ("user", "explain in detail"), ("user", "Explain orders in detail")]
    rows = retrieval.followup_topic(spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id int, turn int, role string, text string")).orderBy("turn").collect()
    assert rows[4].topic == turns[0][1] and rows[5].topic is None and not rows[5].context_only


def test_vector_topk_equals_full_product(spark):
    rng = np.random.default_rng(3)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(n, 8)))
    items, asked = unit(300), unit(5)
    table = spark.createDataFrame([("a", "m", i, v.tolist()) for i, v in enumerate(items)], "analysis_id string, embedding_config string, item_id long, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", "a", "m", v.tolist()) for i, v in enumerate(asked)], "request_id string, analysis_id string, embedding_config string, embedding array<double>")
    got = {}
    for r in retrieval.vector_topk(queries, table, 7, slice_rows=40, query_block=2).collect():
        got.setdefault(r.request_id, set()).add(r.item_id)
    assert got == {f"q{i}": set(np.argsort(-(items @ asked[i]))[:7].tolist()) for i in range(5)}


def test_packing_across_blocks(spark):
    rng = random.Random(5)
    costs = [rng.choice([1, 3, 9, 20]) for _ in range(9000)]
    starts, at = [], 0
    while at < len(costs):
        starts.append(at + 1)
        total, n = costs[at], 1
        while at + n < len(costs) and n < 8 and total + costs[at + n] <= 25:
            total, n = total + costs[at + n], n + 1
        at += n
    table = spark.createDataFrame([("a", i + 1, c) for i, c in enumerate(costs)], "analysis_id string, position long, cost long")
    assert sorted({r.batch_start for r in retrieval.pack_batches(table, 25).select("batch_start").collect()}) == starts


def test_entries_come_down_a_tree_of_maps(spark):
    rng, size, rows, want = random.Random(9), 8, [], {}
    for name, blocks in (("a", 9000), ("b", 64), ("c", 1)):
        maps = [[rng.randrange(size) for _ in range(size)] for _ in range(blocks)]
        rows += [(name, n, m) for n, m in enumerate(maps)]
        at = 0
        for n, m in enumerate(maps):
            want[name, n], at = at, m[at]
    table = spark.createDataFrame(rows, "analysis_id string, _block long, _next array<int>")
    got = {(r["analysis_id"], r["_block"]): r["first"] for r in retrieval.chained_entries(table, size).collect()}
    assert got == want
    assert retrieval.chained_entries(table.where("false"), size).count() == 0


def test_a_refused_batch_is_halved(spark):
    rng = random.Random(4)
    costs = {f"s{n}": [rng.choice([1, 3, 9, 20]) for _ in range(rng.randint(1, 60))] for n in range(30)}
    left = {name: rng.randint(-1, 60) for name in list(costs)[:25]}
    want = []
    for name, own in costs.items():
        at, room, done = 0, max(0, left.get(name, 10**6)), False
        while at < len(own) and not done:
            size = 1
            while at + size < len(own) and size < 8 and sum(own[at:at + size + 1]) <= 25:
                size += 1
            refusals = 0
            while size > room and not done:
                refusals += 1
                if size == 1:
                    done = True
                else:
                    size //= 2
            want.append((name, at + 1, 0 if done else size, refusals))
            at, room = at + size, room - size
    table = spark.createDataFrame([(n, i + 1, c) for n, own in costs.items() for i, c in enumerate(own)], "analysis_id string, position long, cost long")
    remaining = spark.createDataFrame(list(left.items()), "analysis_id string, left long")
    calls = retrieval.calls_of_a_day(retrieval.pack_batches(table, 25), remaining, 25)
    assert sorted(map(tuple, calls.collect())) == sorted(want) and any(r for *_, r in want)


def test_embedding_reuses_the_cache(spark):
    items = spark.createDataFrame([("1", "h1", "alpha beta"), ("2", "h1", "alpha beta"), ("3", "h2", "gamma")], "id string, input_hash string, embedding_text string")
    empty = spark.createDataFrame([], "input_hash string, embedding_config string, embedding array<double>")
    ready, fresh = retrieval.embed_missing(items, empty, "m")
    assert ready.count() == 3 and fresh.count() == 2
    assert retrieval.embed_missing(items, fresh, "m")[1].count() == 0 and retrieval.embed_missing(items, fresh, "other")[1].count() == 2


def test_payload_trims_oldest_turns_first(spark):
    rows = [("r", "question", 1, "q" * 20), *[("r", "turn", i, "t" * 3000) for i in (1, 2)], ("r", "edge", 1, "e" * 3600), ("r", "edge", 2, "e" * 100), *[("r", "source", i, "s" * 5000) for i in (1, 2)]]
    kept = {(r.part, r.position) for r in retrieval.bound_payload(spark.createDataFrame(rows, "request_id string, part string, position int, body string")).collect()}
    assert kept == {("question", 1), ("turn", 2), ("edge", 2), ("source", 1), ("source", 2)}


def test_grounding(spark):
    blocks = spark.createDataFrame([("ok", 1, "fact", ["S1"], ["edge1"]), ("ok", 2, "unknown", [], []), ("cite", 1, "fact", ["S9"], []), ("bare", 1, "fact", [], []), ("edge", 1, "fact", ["S1"], ["edge9"])],
                                   "answer_id string, block_no int, kind string, citation_ids array<string>, edge_ids array<string>")
    registry = spark.createDataFrame([(a, "S1") for a in ("ok", "cite", "bare", "edge")], "answer_id string, citation_id string")
    relations = spark.createDataFrame([("ok", "edge1"), ("edge", "edge1")], "answer_id string, edge_id string")
    assert {r.answer_id: r.reason for r in quality.grounding(blocks, registry, relations).collect()} == {"ok": None, "cite": "citation", "bare": "uncited_fact", "edge": "relationship"}


def test_quota_arithmetic(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert value(retrieval.token_cost(F.lit("é"))) == 130
    assert value(pacific_reset_seconds(F.lit("2026-03-08 08:00:00").cast("timestamp_ntz"))) == 23 * 3600
    now = F.lit("2026-03-08 08:00:00").cast("timestamp_ntz")
    assert [value(retry_after_seconds(F.lit(h).cast("string"), now)) for h in ("61", "0", "junk", None, "Sun, 08 Mar 2026 08:01:30 GMT")] == [61.0, 1.0, 60.0, 60.0, 90.0]
    row = spark.createDataFrame([(100, 30000, None, 700, 10, 3000, 25)], "rpm int, tpm int, rpd int, daily_budget int, rpm_reserve int, tpm_reserve int, daily_reserve int")
    r = admission.quota_limits(row).first()
    assert (r.limit_rpm, r.limit_tpm, r.limit_daily, r.index_rpm, r.index_tpm, r.index_daily) == (70, 21000, 700, 60, 18000, 675)


@pytest.fixture(scope="module")
def arrivals():
    rng, now, rows = random.Random(11), dt.datetime(2024, 1, 1, 5, 0, 0), []
    for i in range(1500):
        now += dt.timedelta(seconds=rng.choice([0.5, 3, 9, 40, 200, 30_000 if rng.random() < 0.02 else 5]))
        rows.append((i, now, rng.choice(["m1", "m1", "m2"]), rng.randint(1, 3), rng.randint(100, 900), rng.random() < 0.7))
    return rows


SCHEMA = "event_id long, ts timestamp_ntz, model string, requests int, tokens long, indexing boolean"
LIMITS = admission.Limits(rpm=8, tpm=3000, rpd=60, index_rpm=6, index_tpm=2400, index_rpd=50)


def whole_key_fold(rows):
    from zoneinfo import ZoneInfo
    step, out = admission.quota_step(LIMITS), {}
    from types import SimpleNamespace
    for model in {r[2] for r in rows}:
        state = admission.QuotaState()
        for r in (r for r in rows if r[2] == model):
            utc = r[1].replace(tzinfo=dt.timezone.utc)
            row = SimpleNamespace(ms=int(utc.timestamp() * 1000), day=utc.astimezone(ZoneInfo("America/Los_Angeles")).date(), requests=r[3], tokens=r[4], indexing=r[5], day_wait=0)
            out[r[0]] = step(state, row)[:2]
    return out


def test_segmented_admission_equals_one_long_fold(spark, arrivals):
    got = {r.event_id: (r.admitted, r.reason) for r in admission.admit(spark.createDataFrame(arrivals, SCHEMA), ["model"], LIMITS).collect()}
    assert got == whole_key_fold(arrivals)
    admitted = [(r[1], r[3], r[4]) for r in arrivals if got[r[0]][0] and r[2] == "m1"]
    window = deque()
    for at, n, t in admitted:
        window.append((at, n, t))
        while window[0][0] <= at - dt.timedelta(seconds=60):
            window.popleft()
        assert sum(w[1] for w in window) <= LIMITS.rpm and sum(w[2] for w in window) <= LIMITS.tpm


def test_streaming_admission_keeps_state_between_batches(spark, arrivals, tmp_path):
    for part in range(3):
        spark.createDataFrame(arrivals[part * 500:(part + 1) * 500], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (admission.admit_stream(stream, "model", LIMITS).writeStream.format("memory").queryName("gate").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(90)
    assert {r.event_id: (r.admitted, r.reason) for r in spark.table("gate").collect()} == whole_key_fold(arrivals)


def test_submissions_open_a_day_long_window(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(hours=h), "ip") for i, h in enumerate((0, 1, 2, 23.9, 24, 25, 26))]
    got = [(r.admitted, r.wait_seconds) for r in admission.submissions(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, ip string"), ["ip"]).orderBy("event_id").collect()]
    assert [a for a, _ in got] == [True, True, False, False, True, True, False] and got[2][1] == 22 * 3600


def test_job_sweep(spark):
    now = dt.datetime(2024, 1, 1, 12)
    ago = lambda s: now - dt.timedelta(seconds=s)
    rows = [("stale", "running", ago(500), None, False), ("live", "running", ago(5), None, False), ("failed", "failed", ago(500), None, False), ("waits", "queued", ago(500), ago(-60), False),
            ("due", "queued", ago(500), ago(60), False), ("stop", "queued", ago(5), None, True), ("busy", "running", ago(5), None, True)]
    table = spark.createDataFrame(rows, "id string, status string, heartbeat_at timestamp_ntz, next_attempt_at timestamp_ntz, cancel_requested boolean")
    got = {r.id: r.action for r in jobs.recover(table, F.lit(now).cast("timestamp_ntz")).collect()}
    assert got == {"stale": "requeue", "live": "none", "failed": "none", "waits": "none", "due": "launch", "stop": "cancel", "busy": "none"}


def test_incremental_intake_is_idempotent(spark, tmp_path):
    schema = "analysis_id string, path string, content string, ord long"
    spark.createDataFrame([("a", "x.py", "1\n", 0), ("b", "y.py", "2\n", 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    from codestrata.sources.snapshots import profile_files
    for attempt in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.incremental_intake(stream, profile_files, str(tmp_path / "out"), str(tmp_path / f"cp{attempt}")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2

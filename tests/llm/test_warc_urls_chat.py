import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from codestrata.llm import chat, url_rules, warc
from codestrata.llm.common import shared_folder

PAGES = "page_id long, url string, html string, uri string, host string"


def test_archives_give_back_every_page(spark):
    long, other = "é" * 700, "z" * 2000
    rows = [(1, "http://a/é b", long), (2, "u", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "v", None), (7, "v", ""),
            (None, "n", other), (8, "n", other), (8, "n", other), (9, "w", "w" * 100_000), (None, "k", "k" * 1500), (None, "k", "k" * 1500)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)
    wanted = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        top = max(same) if same and len(data) >= 1000 else page
        wanted[(page, len(data), hashlib.sha1(data).hexdigest(), "response" if page == top else "revisit", None if page == top else top)] += 1
    found = warc.round_trip(spark, pages)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()) == wanted
    index = warc.write(pages, shared_folder(spark, "test"))
    some = {r.page_id: bytes(r.payload).decode() for r in warc.read(index.filter("page_id IN (3, 9)")).collect()}
    assert some == {3: long, 9: "w" * 100_000}
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_reads_join_near_records():
    assert list(warc._spans([0, 10, 30, 10_000_000], [10, 10, 5, 7])) == [(0, 3), (3, 4)]


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(-len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_rules_agree_with_trying_each(spark):
    draw = random.Random(8)
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("www.a.com", "/en/", "allow"), ("net", "/e", "block"), ("b.net", "", "block"), ("b.net", "/en/x", "allow")]
    urls = [None, "", "nothing", "http://", "HTTP://COM", "http://com?x", "http://com/", "x://y://com/a", "http://ÀA.com/en/", "http://" + "a." * 500 + "com/" + "p" * 5000]
    for _ in range(300):
        host = ".".join(draw.choice(["a", "b", "www", "COM", "net", "com"]) for _ in range(draw.randint(1, 4)))
        urls.append(f"http://{host}{draw.choice(['', '/', '/en/', '/en/x', '/e?q#r', '#t', '?/en/'])}")
    urls += urls[:20]
    pages = spark.createDataFrame([(i // 2, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([*rules, (None, "/", "block"), ("net", None, "block")], "host string, path string, action string")
    wanted = Counter((i // 2, *plain_verdict(u, rules)) for i, u in enumerate(urls))
    assert Counter(tuple(r) for r in url_rules.judge(pages, listed).collect()) == wanted
    bare = url_rules.judge(pages, listed.limit(0), default="block").collect()
    assert len(bare) == len(urls) and {(r.rule, r.verdict) for r in bare} == {(None, "block")}
    assert url_rules.judge(pages.limit(0), listed).count() == 0


def test_snapshots_collapse_and_the_rest_is_rendered(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    monkeypatch.setattr(chat, "PART", 2)
    talks = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: [""], 6: [None], 7: ["a"] * 11, 8: ["a"] * 7, 9: ["z" * 9000], None: ["q", "r"]}
    rows = [(c, t, "user", x, "e") for c, texts in talks.items() for t, x in enumerate(texts)] + [(10, 0, None, "t", "e"), (10, 0, None, "t", "e"), (11, None, "user", "t", "e")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")
    kept = {(r.conv_id, r.n_turns, r.part): r.text for r in chat.render(turns).collect()}
    assert {k[0] for k in kept} == {2, 4, 5, 6, 7, 9, 10, 11, None}
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert kept[(2, 3, 0)] == line("user", "a") + line("user", "b") and kept[(2, 3, 1)] == line("user", "c")
    assert kept[(6, 1, 0)] == kept[(5, 1, 0)] == line("user", "")
    assert "".join(kept[(7, 11, p)] for p in range(6)) == line("user", "a") * 11
    assert kept[(10, 2, 0)] == line("", "t") * 2 and kept[(9, 1, 0)] == line("user", "z" * 9000)
    assert chat.render(turns.limit(0)).count() == 0
    plan = chat.render(turns)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert turns.filter(F.col("conv_id").isNull()).count() == 2

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemill.functions import fetch, links
from tidemill.functions import text as T
from tidemill.operators import dedup, events, metrics, records
from tidemill.sources.io import console_logs

T0 = datetime(2024, 1, 1)
REQ = "ts timestamp, seq bigint, domain string, success boolean, is_ban boolean"


def at(s):
    return T0 + timedelta(seconds=s)


def test_sev1_needs_a_failure_last(spark):
    make = lambda oks: spark.createDataFrame([(at(i), i, "d", ok, False) for i, ok in enumerate(oks)], REQ)
    assert events.sev1_exact(make([False] * 8 + [True] * 2)).count() == 0
    assert events.sev1_exact(make([True] * 2 + [False] * 8)).count() == 1 == events.sev1_windows(make([True] * 2 + [False] * 8)).count()


def test_sev1_exact_like_a_loop(spark):
    rng = random.Random(5)
    t, rows = 0, []
    for i in range(300):
        t += rng.choice([0, 1, 5, 40, 200])
        rows.append((at(t), i, "d", rng.random() < 0.4, False))
    start, won, total, want = None, 0, 0, []
    for ts, seq, _, ok, _ in rows:
        start = start or ts
        won, total = won + ok, total + 1
        if (ts - start).total_seconds() > 300:
            start, won, total = ts, 0, 0
        if not ok and total >= 10 and won / total < 0.5:
            want.append(seq)
    assert [r["seq"] for r in events.sev1_exact(spark.createDataFrame(rows, REQ)).orderBy("seq").collect()] == want


def test_cooldown_mutes_other_domains(spark):
    rows = [(at(0), 0, "A"), (at(100), 1, "B"), (at(299), 2, "A"), (at(300), 3, "B"), (at(301), 4, "A")]
    got = events.fired(events.circuit_alerts(spark.createDataFrame(rows, "ts timestamp, seq bigint, domain string"))).collect()
    assert sorted(r["seq"] for r in got) == [0, 3]


def test_ban_rate(spark):
    rows = [(at(i), i, "d", False, True) for i in range(12)]
    got = events.sev3_events(spark.createDataFrame(rows, REQ)).collect()
    assert [r["seq"] for r in sorted(got, key=lambda r: r["seq"])] == [9, 10, 11]


def test_circuit(spark):
    f = "ts timestamp, seq bigint, domain string, url string"
    early = [(at(0), 1, "d", "u1"), (at(10), 2, "d", "u2"), (at(20), 3, "d", "u3"), (at(59 * 60), 4, "d", "u4")]
    late = [*early[:3], (at(61 * 60), 4, "d", "u4")]
    a, b = (events.failure_counts(spark.createDataFrame(x, f)) for x in (early, late))
    assert [r["url"] for r in events.handed_over(a).collect()] == ["u4"] and events.handed_over(b).count() == 0
    ask = spark.createDataFrame([(at(30), "d"), (at(10 * 86400), "d"), (at(0), "other")], "ts timestamp, domain string")
    assert sorted((r["domain"], r["state"], r["failure_count"]) for r in events.circuit_states(a, ask).collect()) == [("d", "closed", 3), ("d", "open", 4), ("other", "closed", 0)]
    assert sorted(r["failure_count"] for r in events.circuit_states(b, ask).collect()) == [0, 0, 3]


def test_robots(spark):
    d = lambda t: tuple(spark.createDataFrame([(t,)], "t string").select(events.crawl_delay(F.col("t"), "TideBot/1.0").alias("x")).first()["x"])
    assert d("User-agent: *\nCrawl-delay: 2") == (2000, 4000) and d(None) == (1000, 2000) == d("User-agent: other\nCrawl-delay: 9")
    assert d("# c\nUser-agent: tidebot\nCrawl-Delay: 5\nUser-agent: x\nCrawl-delay: 7") == (5000, 10000)
    assert d("User-agent: *\nCrawl-delay: x") == (1000, 2000) and d("User-agent: *\nCrawl-delay: 0.5") == (500, 1000)
    robots = "User-agent: *\nDisallow: /private/\nAllow: /private/ok\n\nUser-agent: goodbot\nDisallow: /*.pdf$\n"
    assert events.allowed(robots, "x", "/public/a") and not events.allowed(robots, "x", "/private/a") and events.allowed(robots, "x", "/private/ok")
    assert events.allowed(robots, "GoodBot/2", "/private/a") and not events.allowed(robots, "GoodBot/2", "/a.pdf") and events.allowed(robots, "GoodBot/2", "/a.pdfx")


def test_memory(spark):
    s = spark.createDataFrame([(at(i), v) for i, v in enumerate([50.0, 91.0, 88.0, 84.0, 89.0, 95.0])], "ts timestamp, used_percent double")
    assert [r["under_pressure"] for r in events.pressure(s).orderBy("ts").collect()] == [False, True, True, False, False, True]


def test_metrics(spark):
    log = spark.createDataFrame([(at(i), *x) for i, x in enumerate([("requests_total", "success", 1.0), ("requests_total", "success", 1.0), ("domain_ban_rate", "d", 0.5), ("domain_ban_rate", "d", 1.7), ("request_duration_seconds", "fast", 0.2), ("request_duration_seconds", "fast", 20.0)])], "ts timestamp, metric string, label string, value double")
    assert metrics.counters(log).first()["value"] == 2.0 and metrics.gauges(log).first()["value"] == 1.0
    h = {r["bound"]: r["n"] for r in metrics.histogram(log).collect()}
    assert h[0.1] == 0 and h[0.25] == 1 and h[10.0] == 1 and h[None] == 2
    c = metrics.collected(spark.createDataFrame([(True, 500), (True, 500), (False, 500)], "success boolean, bytes bigint")).first()
    assert abs(c["success_rate"] - 2 / 3) < 1e-9 and c["total_bytes"] == 1500
    assert events.alert_stats(spark.createDataFrame([], REQ)).first()["success_rate"] == 1.0


def test_fetch(spark):
    big = "x" * 500
    rows = [(403, big), (429, ""), (500, big), (200, "tiny"), (200, big + "<title>Just a MOMENT</title>"), (200, big + "cf-turnstile"), (200, big), (200, None)]
    got = spark.createDataFrame(rows, "s int, b string").select(fetch.classify(F.col("s"), F.col("b")).alias("o")).collect()
    assert [r["o"] for r in got] == ["hard_ban", "hard_ban", "error", "empty", "soft_ban", "soft_ban", "ok", "empty"]
    tries = spark.createDataFrame([("a", 0, "soft_ban"), ("a", 1, "ok"), ("b", 0, "error"), ("b", 1, "ok"), ("c", 0, "empty"), ("c", 1, "hard_ban"), ("c", 2, "empty")], "url string, tier int, outcome string")
    assert {(r["url"], r["tier"], r["outcome"]) for r in fetch.escalate(tries).collect()} == {("a", 1, "ok"), ("b", 0, "error"), ("c", 2, "empty")}


def test_links(spark):
    rows = [(1, "https://example.com/docs/guide", "Documentation Guide"), (2, "http://example.com/a/b/c/d/e/f?x=1#y", "ad"), (3, "not a url", "x"), (4, "https://example.com/api/v1", None)]
    r = {x["pos"]: x for x in links.scored(spark.createDataFrame(rows, "pos int, url string, anchor string")).collect()}
    assert r[1]["score"] == 9.5 and r[3]["score"] == 5.0 and r[4]["path_bonus"] == 2.5
    assert (r[2]["ad_penalty"], r[2]["depth_penalty"], r[2]["query_penalty"], r[2]["fragment_penalty"]) == (-1.0, -1.0, -0.3, -0.5)
    q = links.queue(links.scored(spark.createDataFrame(rows, "pos int, url string, anchor string")), "pos", 2).orderBy("rank").collect()
    assert [x["pos"] for x in q] == [1, 2]


def test_dedup(spark):
    base = "The quick brown fox jumps over the lazy dog and runs through the forest near the old river in the modern "
    docs = [(1, "u1", 1, base + "world"), (2, "u2", 2, base + "era"), (3, "u1", 3, "something else entirely, about the price of tea"), (4, "u4", 1, "a third topic of which nobody has written"), (5, "u2", 5, "a fourth topic, on mountains and their names"), (6, "u6", 6, ""), (7, "u7", 7, "")]
    got = {r["seq"]: (r["status"], r["original_id"]) for r in dedup.check_and_index(spark.createDataFrame(docs, "seq bigint, url string, content_hash bigint, text string")).collect()}
    assert got == {1: ("unique", None), 2: ("near_duplicate", 1), 3: ("duplicate_url", None), 4: ("duplicate_hash", None), 5: ("unique", None), 6: ("unique", None), 7: ("near_duplicate", 6)}
    assert dedup.bloom_size(100_000, 0.01) == (958_506, 7)


def test_dedup_in_parts(spark, sf):
    """Parts settle what the whole table does, with and without keys, and no table of pairs spans them."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("seq"), "text").limit(160)
    d = d.union(d.where("seq % 5 = 0").select(F.col("seq") + 100_000, "text")).union(d.where("seq % 7 = 0").select(F.col("seq") + 200_000, F.concat("text", F.lit(" x"))))
    d = d.select("seq", F.concat(F.lit("u"), (F.col("seq") % 150).cast("string")).alias("url"), F.when(F.col("seq") % 3 > 0, F.md5("text")).alias("content_hash"), "text").localCheckpoint()
    for f in (dedup.near_duplicates, dedup.check_and_index):
        got = [sorted(map(tuple, f(d, part=n).collect())) for n in (60, 10_000)]
        assert got[0] == got[1] and len(got[0]) == d.count()


def test_dedup_sends_no_sets(spark):
    """However alike the texts, neither sets, nor marks, nor pairs of documents go through a shuffle: parts are compared with kept documents where these lie."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    rows = [(i, f"u{i}", i, " ".join(rng.choice(vocabulary) for _ in range(120))) for i in range(400)]
    d = spark.createDataFrame(rows, "seq bigint, url string, content_hash bigint, text string")
    shuffled = lambda: sum(spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(spark.sparkContext._jsc.sc().statusStore().executorList(False).size()))
    before = shuffled()
    got = dedup.check_and_index(d, part=100).collect()
    assert len(got) == 400 and shuffled() - before < sum(len(r[3]) for r in rows) / 4


def test_dedup_like_a_loop(spark, sf):
    """Against the greedy rule, document by document, over sets of 3-grams; also by signatures, which only must settle alike in any parts."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("seq"), "text")
    d = d.union(d.where("seq % 4 = 0").select(F.col("seq") + 100_000, F.concat("text", F.lit(" y")))).localCheckpoint()
    sets = {r["seq"]: frozenset(r["g"]) for r in d.select("seq", T.shingles(F.col("text")).alias("g")).collect()}
    alike = lambda a, b: 1.0 if not a | b else round(len(a & b) / len(a | b), 6)
    kept, want = [], {}
    for i in sorted(sets):
        near = next((k for k in kept if alike(sets[i], sets[k]) >= 0.85), None)
        want[i] = ("unique", None, None) if near is None else ("near_duplicate", near, alike(sets[i], sets[near]))
        if near is None:
            kept.append(i)
    got = {r["seq"]: (r["status"], r["original_id"], r["similarity"]) for r in dedup.near_duplicates(d, part=50).collect()}
    assert got == want
    by_signature = [sorted(map(tuple, dedup.near_duplicates(d, part=n, verify="signature").collect())) for n in (50, 10_000)]
    assert by_signature[0] == by_signature[1] and len(by_signature[0]) == len(want)


def test_greedy_is_no_component(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 7)], "seq bigint")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9), (1, 5, 0.95), (3, 5, 0.9)], "a bigint, b bigint, similarity double")
    got = {r["seq"]: r["original_id"] for r in dedup.greedy(ids, pairs).where("status <> 'unique'").collect()}
    assert got == {2: 1, 4: 3, 5: 1}


def test_greedy_like_a_loop(spark):
    rng = random.Random(3)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if a != b})
    kept, want = [], {}
    for i in range(40):
        near = [k for k in kept if (k, i) in pairs]
        if near:
            want[i] = min(near)
        else:
            kept.append(i)
    got = dedup.greedy(spark.createDataFrame([(i,) for i in range(40)], "seq bigint"), spark.createDataFrame([(a, b, 0.9) for a, b in pairs], "a bigint, b bigint, similarity double")).collect()
    assert {r["seq"]: r["original_id"] for r in got if r["status"] != "unique"} == want


def test_records(spark):
    df = spark.createDataFrame([(1, "good text"), (2, "")], "id bigint, text string")
    r = records.new_records(df, F.concat(F.lit("u"), F.col("id").cast("string")), F.col("id"), F.col("text"), F.lit(5), quality_score=F.lit(7.0), embedding=F.array(F.lit(1.0)))
    first = r.orderBy("content_hash").first()
    assert (first["quality_score"], first["embedding"], first["media_json"], first["is_deleted"], len(first["id"])) == (1.0, None, "[]", False, 36)
    done = {x["content_hash"]: x for x in records.enriched(r, F.lit(9)).collect()}
    assert done[1]["sentiment_score"] == 1.0 and done[1]["updated_at"] == 9 and done[2]["error"] == "Empty text" and done[2]["updated_at"] == 5
    gone = records.soft_deleted(r, F.col("content_hash") == 1, F.lit(8))
    assert records.unenriched(gone, 10).count() == 1 and records.unenriched(gone, 10, include_deleted=True).count() == 2
    up = r.where("content_hash = 1").withColumn("title", F.lit("t"))
    assert {x["content_hash"]: x["title"] for x in records.upserted(r, up).collect()} == {1: "t", 2: None}
    assert records.missed(r, up.withColumn("id", F.lit("none"))).count() == 1


def test_console_logs(spark):
    logs = '[{"type":"log","timestamp":1,"message":"a"},{"type":"warn","message":"b"}]'
    got = console_logs(spark.createDataFrame([(1, logs), (2, "broken"), (3, None)], "id int, j string"), ["id"], "j").collect()
    assert [(r["log_type"], r["message"]) for r in got] == [("log", "a")]

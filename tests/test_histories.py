"""Crawls, sources as partitions, tables with history, runs, memory, settings, reviews and verdicts as state."""

import random

import pytest
from pyspark.sql import functions as F

from siftmill.operators import crawl, logs
from siftmill.sources import recorded
from siftmill.sources.history import Conflict, History, resumed
from siftmill.streaming.verdicts import held_verdicts, held_verdicts_of, never_held


def test_reached_ends_in_circles_and_keeps_its_bounds(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), (None, "z"), ("a", None), ("d", "e"), ("e", "f")]
    df, seeds = spark.createDataFrame(links, "source string, target string"), spark.createDataFrame([("a",), (None,)], "node string")
    got = lambda *a: sorted(map(tuple, crawl.reached(df, seeds, *a).collect()))
    assert got(9) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4), ("f", 5)]
    assert got(2) == [("a", 0), ("b", 1), ("c", 2)]
    assert [n for n, _ in got(9, 4)] == list("abcd")
    assert got(0) == [("a", 0)]


def test_addresses_are_resolved(spark):
    html = """<a href="/x">1</a><A class=k HREF = '../y'>2</A><a href=z.html#t>3</a><a data-k="1" href="//h.org/q?a=1&amp;b=2">4</a><a href="mailto:a@b.c">5</a><a href="#top">6</a><a name="n">7</a><a href="?p=2">8</a><a href="HTTPS://Q.org">9</a>"""
    pages = spark.createDataFrame([("https://s.example.com/d/e?x=1", html), ("https://s.example.com", '<a href="k">')], "url string, html string")
    got = [r["href"] for r in crawl.anchors(pages).orderBy("url", "pos").collect()]
    assert got == ["https://s.example.com/k", "https://s.example.com/x", "https://s.example.com/d/../y", "https://s.example.com/d/z.html", "https://h.org/q?a=1&b=2", "https://s.example.com/d/e?p=2", "HTTPS://Q.org"]
    pair = spark.createDataFrame([("https://a.b.com/x", "http://B.com:80/", True), ("https://b.com", "https://b.org", False), ("nothing", "nothing", False), ("https://u@x.b.com?q", "https://b.com#k", True)], "a string, b string, same boolean")
    assert all(r[0] == r[1] for r in pair.select("same", crawl.same_domain(F.col("a"), F.col("b"))).collect())


def test_site_maps_by_their_own_declaration(spark):
    maps = [
        ("i", "<sitemapindex><loc>m1</loc><loc> jobs/m2 </loc><loc><![CDATA[m3]]></loc><loc>i</loc></sitemapindex>"),
        ("m1", "<urlset><loc>p1</loc><loc>p2.xml</loc></urlset>"), ("jobs/m2", "<urlset><loc>p3</loc><loc>p1</loc><loc>m1</loc></urlset>"), ("m3", "<urlset><loc>p9</loc></urlset>"), ("p2.xml", "<urlset><loc>p4</loc></urlset>"), ("other", None),
    ]
    docs, seeds = spark.createDataFrame(maps, "url string, body string"), spark.createDataFrame([("s", "i"), ("t", "m1"), ("u", "gone")], "site string, map string")
    got = lambda **k: sorted(map(tuple, crawl.site_map_pages(docs, seeds, **k).collect()))
    assert got() == [("s", p) for p in ("m1", "p1", "p3", "p4", "p9")] + [("t", "p1"), ("t", "p4")]
    assert got(most_maps=2) == [("s", p) for p in ("m1", "p1", "p3", "p4")] + [("t", "p1"), ("t", "p4")]  # the one that speaks of jobs first
    assert got(most_depth=1, limit=2) == [("s", "m1"), ("s", "p1"), ("t", "p1"), ("t", "p4")]


def test_recorded_sources_fail_alone_and_conditions_choose_files(spark, tmp_path):
    for source, page, text in (("a", 1, '{"k": 1}\n\n{"k": 2}\n'), ("a", 2, ""), ("b", 1, '{"k": 3}\n<html>'), ("c", 7, '{"k": 4}')):
        folder = tmp_path / "r" / f"source={source}" / f"page={page}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text(text)
    recorded.register(spark)
    rows = spark.read.format("recorded").option("path", str(tmp_path / "r")).load()
    assert sorted((r["source"], r["page"], r["item"], r["problem"] is None) for r in rows.collect() if r["item"] or r["problem"]) == [("a", 1, '{"k": 1}', True), ("a", 1, '{"k": 2}', True), ("b", 1, None, False), ("c", 7, '{"k": 4}', True)]
    reader = recorded.RecordedReader(str(tmp_path / "r"), 1)
    assert list(reader.pushFilters([recorded.In(("source",), ("a", "c")), recorded.EqualTo(("page",), 7), recorded.EqualTo(("item",), "x")])) == [recorded.EqualTo(("item",), "x")]
    assert [(p.source, p.page) for p in reader.partitions()] == [("c", 7)]


def test_history_equals_a_dictionary(spark, tmp_path):
    rng, state, versions = random.Random(2), {}, [{}]
    table = History(spark, str(tmp_path / "t"), "k", "k long, v string, n double")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, n double")
    rows_of = lambda df: {r["k"]: (r["v"], r["n"]) for r in df.collect()}
    for step in range(6):
        source = {rng.randrange(12): (rng.choice(["a", "b", "gone", "keep", None]), float(step)) for _ in range(6)}
        if step == 3:
            table.delete(frame([(k, None, None) for k in range(4)]))
            state = {k: x for k, x in state.items() if k > 3}
        elif step == 4:
            table.compact()
        else:
            table.merge(frame([(k, *x) for k, x in source.items()]), delete=F.col("new.v") == "gone", keep=F.col("new.v") == "keep", delete_missing=step == 5)
            old = state
            state = {} if step == 5 else dict(old)
            for k, x in source.items():
                if x[0] == "gone":
                    state.pop(k, None)
                elif not (x[0] == "keep" and k in old):
                    state[k] = x
                else:
                    state[k] = old[k]
        versions.append(dict(state))
    assert [rows_of(table.read(v)) for v in range(7)] == versions
    one = next(iter(state))
    table.merge(frame([(one, "z", 9.0), (99, "q", 9.0)]), update={"v": F.concat(F.coalesce("old.v", F.lit("-")), "new.v")}, insert=False)
    assert rows_of(table.read())[one] == ((state[one][0] or "-") + "z", state[one][1]) and 99 not in rows_of(table.read())
    before = table.changes().count()
    table.put(frame([(k, *x) for k, x in rows_of(table.read()).items()]))
    assert table.changes().count() == before  # nothing changed, nothing is written
    table.clear()
    assert rows_of(table.read()) == {} and rows_of(table.read(6)) == versions[6]
    for bad in ([(1, "a", 0.0), (1, "b", 0.0)], [(None, "a", 0.0)]):
        with pytest.raises(ValueError, match="k must be"):
            table.put(frame(bad))
    with pytest.raises(Conflict):
        table._commit(frame([]).select("*", F.lit(True).alias("_gone")), "changes", "late", 2)


def test_stages_go_on_where_they_ended(spark, tmp_path):
    start, broken = spark.range(10).toDF("k"), [True]

    def second(df):
        if broken[0]:
            raise RuntimeError("lost")
        return df.filter("k > 3")

    stages = [("first", lambda df: df.filter("k > 1")), ("second", second), ("third", lambda df: df.withColumn("x", F.col("k") * 2))]
    path = str(tmp_path / "s")
    with pytest.raises(RuntimeError):
        resumed(spark, path, start, stages)
    broken[0] = False
    rows, ran = resumed(spark, path, start, stages)
    assert ran == ["second", "third"] and sorted(r["k"] for r in rows.collect()) == list(range(4, 10))
    assert resumed(spark, path, start, stages)[1] == []


def test_canonical_settings(spark):
    alike = [('{"a": [1, 2, {"x": 1, "y": ""}], "b": " t "}', '{"b": "t", "z": null, "a": [{"y": null, "x": "1"}, "2", 1, 2, " "]}'), ("[]", '{"a": {}}'), ('"x"', '" x "'), ("true", "true")]
    unlike = [('["a,b"]', '["a", "b"]'), ('{"a": "1\\"=\\"2"}', '{"a": "1", "b": "2"}'), ('[{"a": 1, "b": 2}, {"a": 3, "b": 4}]', '[{"a": 1, "b": 4}, {"a": 3, "b": 2}]'), ("true", "false"), ('{"a": 1}', '["a", 1]')]
    df = spark.createDataFrame([(a, b, True) for a, b in alike] + [(a, b, False) for a, b in unlike], "a string, b string, same boolean")
    form = lambda c: logs.canonical(F.parse_json(c))
    for r in df.select("a", "b", "same", form("a").alias("x"), form("b").alias("y")).collect():
        assert (r["x"] == r["y"]) == r["same"], r


def test_batches_keep_the_budget_and_every_row_is_answered_once(spark):
    rng = random.Random(5)
    rows = [(k, "w" * rng.choice([0, 1, 30, 90, 400]), rng.choice(["a", "a", "b", None])) for k in range(300)]
    df = logs.batched(spark.createDataFrame(rows, "id long, text string, key string"), F.length("text"), "key", 200, shares=3)
    groups = {}
    for r in df.collect():
        groups.setdefault(r["batch"], []).append(r)
    assert sum(map(len, groups.values())) == 300
    for g in groups.values():
        assert len({r["key"] for r in g}) == 1 and (len(g) == 1 or sum(len(r["text"]) for r in g) <= 200)

    def review(batch):
        if (batch["id"] % 17 == 0).any():
            raise ValueError("no")
        return [(i, f"{len(t)}") for i, t in zip(batch["id"], batch["text"], strict=True) if i % 13] + [(-5, "?")]

    got = sorted(map(tuple, logs.reviewed(df, review).collect()))
    assert got == [(k, "failed" if k % 17 == 0 or k % 13 == 0 else str(len(t))) for k, t, _ in rows]


def test_runs_and_memory(spark):
    rows = [(1, "2024-01-01 00:00:00", "a", 1), (1, "2024-01-01 00:50:00", "a", 1), (1, "2024-01-01 03:00:00", "", 1), (1, "2024-01-01 04:00:00", "b", 0), (2, "2024-01-01 00:00:00", None, 1), (2, "2024-01-02 00:00:00", "c", 2), (3, None, "d", 1)]
    df = spark.createDataFrame(rows, "k long, t string, v string, version int").withColumn("t", F.to_timestamp("t"))
    got = sorted((r["k"], r["ago"], r["events"], r["n"]) for r in logs.runs(df, "k", "t", "1 hour", n=F.sum("version")).collect())
    assert got == [(1, 1, 2, 1), (1, 2, 2, 2), (2, 1, 1, 2), (2, 2, 1, 1)]
    known = logs.remembered(df, "k", "v", "version", ["t"], 1)
    assert sorted((r["k"], r["v"], r["holds"]) for r in known.collect()) == [(1, "", False), (1, "a", False), (2, "c", True), (3, "d", True)]


def test_verdicts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), k, 600 * k + rng.randrange(500), rng.randrange(3), rng.choice([None, None, "yes", "no"])) for k in range(200)]
    df = spark.createDataFrame(rows, "key string, id long, s long, version int, verdict string").withColumn("ts", F.when(F.col("id") % 11 > 0, F.timestamp_seconds("s"))).drop("s").select("key", "id", "ts", "version", "verdict")
    for k in range(3):
        df.filter(f"id between {k * 70} and {k * 70 + 69}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    out = f"{tmp_path}/out"
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    held_verdicts(stream, "45 minutes", 1).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    held = spark.read.schema("key string, id long, ts timestamp, hit boolean, verdict string").parquet(f"{out}/batch=*").unionByName(never_held(df))
    key = lambda r: (r["id"], r["hit"], r["verdict"])
    want = sorted(map(key, held_verdicts_of(df, "45 minutes", 1).collect()))
    assert sorted(map(key, held.collect())) == want and len(want) == sum(r[4] is None for r in rows)
    assert any(w[1] for w in want) and not all(w[1] for w in want)

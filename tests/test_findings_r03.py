"""What the findings of the third round were about."""

import duckdb

import __spark_entry__ as entry


def same_as_sql(spark, folder, name, tables):
    """The query's rows and its SQL's over the same small tables, sorted."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    order = lambda rows: sorted(map(repr, map(tuple, rows)))
    return order(entry.queries()[name](spark, str(folder)).collect()), order(con.sql(entry.oracle_sql()[name]).fetchall())


def test_search_cleanup_agrees_on_addresses_with_long_numbers(spark, tmp_path):
    """an address with a number of four digits is a single page, whatever follows it."""
    html = lambda k: f'<title>Job {k}</title><a href="/x{k}">x</a> <a href="/the">y</a> responsibilities'
    rows = [(9, "http://a/12", html(9)), (18, "http://a/12345", html(18)), (27, "http://a/en/99?x=1", html(27)), (4, "http://a/99999", html(4)), (54, "http://a/jobs/1234#top", html(54))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got, told = same_as_sql(spark, tmp_path, "search_cleanup", ["pages"])
    assert got == told
    assert any("12345//jobs/" in r or "12345/jobs/" in r for r in got) and not any("/x18" in r for r in got) and any("/x9" in r for r in got)


def test_canonical_settings_are_written_once_at_every_level(spark):
    """F8: the plan must not compute a level of the settings several times over."""
    from pyspark.sql import functions as F

    from siftmill.operators import logs

    rows = spark.createDataFrame([('{"b": ["x", "x", " y "], "a": {"q": "say \\"\\\\\\""}, "n": null, "e": {}}',), (None,), ("[]",), ("3",)], "s string")
    form = logs.canonical(F.parse_json("s"))
    assert [r[0] for r in rows.select(form).collect()] == ['{"a"={"q"="say \\"\\\\\\""},"b"=["x","y"]}', "", "", '"3"']
    plan = rows.select(form.alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("map_entries") <= 7 and len(plan) < 60_000


def test_site_maps_in_parts_are_one_map(spark, tmp_path, monkeypatch):
    """a host's map comes in parts, and a page with very many addresses is not read again for each."""
    from siftmill.operators import crawl
    from siftmill.plans import history_queries

    monkeypatch.setattr(history_queries, "MAP_PART", 3)
    rows = [(k, f"http://h{k % 8}.example.{'com' if k % 2 else 'net'}/p{k}") for k in range(60)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got, told = same_as_sql(spark, tmp_path, "site_map_pages", ["pages"])
    assert got == told and len(got) == 60
    long = "<urlset>" + "".join(f"<loc>http://a/{k}</loc>" for k in range(30_000)) + "</urlset>"
    maps = spark.createDataFrame([("m", long)], "url string, body string")
    assert crawl.site_map_pages(maps, spark.createDataFrame([("s", "m")], "site string, map string"), limit=40_000).count() == 30_000


def test_profiles_hold_a_bounded_number_of_grams(spark, monkeypatch):
    """a batch of texts is added up in bounded pieces, with the same profiles."""
    from siftmill.operators import languages

    docs = spark.createDataFrame([("the cat and the hat " * 9, "en"), ("die Katze und der Hut " * 9, "de")] * 20, "text string, lang string").coalesce(1)
    whole = sorted(map(tuple, languages.profiles(docs).collect()))
    monkeypatch.setattr(languages, "HELD_GRAMS", 100)
    assert sorted(map(tuple, languages.profiles(docs).collect())) == whole


def test_uncertain_from_the_category_that_words_told(spark):
    """the category found by words tells the same as reading the texts again."""
    from pyspark.sql import functions as F

    from siftmill.operators import predicates as P

    rows = [("Master thesis", "x", "", "de"), ("Ingenieur", "ein internship", "", "de"), ("Ingenieur", "y", "", "de"), ("Ingenieur", "y", "", None), ("Ingenieur", "y", "Contract", "de"), (None, None, "", "fr"), ("Engineer", "y", None, "en")]
    df = spark.createDataFrame(rows, "t string, b string, e string, l string")
    found = P.uncertain_of(P.category(F.col("t"), F.col("b"), F.lit("")), F.col("e"), F.col("l"))
    assert [r[0] for r in df.select(found).collect()] == [False, False, True, False, False, True, False]


def test_rules_around_hits_compute_their_text_once(spark):
    """the text of a rule is one expression of its plan, however long the rule."""
    from pyspark.sql import functions as F

    from siftmill.functions import text as T
    from siftmill.operators import predicates as P

    df = spark.createDataFrame([("fluent   German is a must",), ("fluent german, or english",), ("nothing",), (None,)], "d string")
    rule = P.asks_other_language(T.squeezed(F.col("d")))
    assert [r[0] for r in df.select(rule).collect()] == [True, False, False, False]
    assert df.select(rule.alias("r"))._jdf.queryExecution().optimizedPlan().toString().count("[\\s]+") == 1


def test_texts_of_a_cell_are_compared_without_loss(monkeypatch):
    """All pairs of two blocks by their distinct words at once, with the ratios of each pair by itself."""
    import random

    from siftmill.functions import similarity as S

    monkeypatch.setattr(S, "STRIP", 16)
    monkeypatch.setattr(S, "MASK_BYTES", 2_000)
    rng, links = random.Random(3), 0
    for letters in ("ab", "abcdef", "abcdefghijklmnopqé𝔘"):
        base = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(20)]
        words = lambda: {"".join(c for c in w if rng.random() > 0.15) + "z" * (rng.random() < 0.2) for w in rng.choices(base, k=rng.randrange(0, 20))} - {""}  # noqa: B023, E731
        a, b = ([" ".join(sorted(words())) for _ in range(n)] for n in (14, 9))
        for least, (x, y, alone) in [(least, side) for least in (60, 80) for side in ((a, b, False), (a, a, True))]:
            each = {(i, j): S.token_set(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if not alone or i < j}
            want = {p: score for p, score in each.items() if score >= least}
            assert {(i, j): score for i, j, score in S.like_texts(x, y, least, alone)} == want
            assert {(i, j) for i, j, _ in S.like_texts(x, y, least, alone, scored=False)} == set(want)
            links += len(want)
    assert links > 100


def test_short_titles_meet_by_whole_pieces():
    """Every pair of like short titles shares a piece, and few others do."""
    import itertools
    import random

    from siftmill.functions.similarity import ratio
    from siftmill.operators import survivorship as S

    rng = random.Random(5)
    for r, letters in ((0.9, "ab"), (0.9, "abcdefghijklmnop"), (0.75, "abcdefgh"), (0.6, "ab")):
        base = ["".join(rng.choices(letters, k=rng.randrange(1, 62))) for _ in range(40)]
        words = sorted({w for b in base for w in (b, b[: int(len(b) * r / (2 - r)) + 1], *("".join(c for c in b if rng.random() > p) for p in (0.05, 0.15)))} - {""})
        keys = lambda w, shorter: {(int(k), w[i:j]) for k, (i, j) in zip(*S.pieces_of(len(w), r, shorter), strict=True)}  # noqa: B023, E731
        short, long = ({w: keys(w, side) for w in words} for side in (True, False))
        pairs = [sorted(p, key=len) for p in itertools.combinations(words, 2)]
        met = [bool(short[a] & long[b]) for a, b in pairs]
        assert all(m for m, (a, b) in zip(met, pairs, strict=True) if ratio(a, b) >= 100 * r)
        assert len(letters) < 16 or sum(met) < len(pairs) / 5


_HELD = """
import random
import numpy as np
import pyarrow as pa
from siftmill.llm import collocations as C

class Docs:
    select = lambda self, *_: self
    mapInArrow = lambda self, run, _: run

C.HELD = 400_000
full = lambda bits: np.full(1 << (bits - 3), 255, dtype=np.uint8)
plan = C.Plan(full(C.WORD_BITS), full(C.PAIR_BITS), np.zeros(0, dtype=np.int64), np.arange(1 << C.CLASS_BITS) % 100, np.zeros(1 << C.CLASS_BITS, dtype=np.int64), 100)
rng = random.Random(2)
texts = [" ".join(f"{rng.randrange(300)}w" for _ in range(1_000)) for _ in range(900)]
batches = pa.table({"text": texts, "lang": ["en"] * len(texts)}).to_batches(max_chunksize=50)
total = sum(int(b["n"].to_numpy().sum()) for b in C.suffixes(Docs(), plan, 1 << 16)(iter(batches)))
print(total, pa.default_memory_pool().max_memory() / C.HELD)
"""


def test_suffixes_of_a_task_are_added_up_in_little_memory():
    """op13_collocations: adding up what a task holds must not hold all of it several times over; in a process of its own,
    as Arrow counts its memory by the process."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", _HELD], capture_output=True, text=True, cwd=root, check=True, timeout=120).stdout.split()
    assert int(out[0]) == 900_000
    assert float(out[1]) < 130, out


def test_keys_share_states_and_calls(spark, tmp_path):
    """a batch is a call for each group of keys, not for each key, with the verdicts of the whole table."""
    import random

    from pyspark.sql import functions as F

    from siftmill.streaming.verdicts import held_verdicts, held_verdicts_of

    rng = random.Random(4)
    rows = [(f"k{rng.randrange(300)}", k // 2, 1_000_000 + 20 * (k // 3), rng.randrange(3), rng.choice([None, None, "yes", "no"])) for k in range(4_000)]
    df = spark.createDataFrame(rows, "key string, id long, s long, version int, verdict string").withColumn("ts", F.timestamp_seconds("s")).drop("s").dropDuplicates(["key", "id", "ts"])
    schema, out, totals = df.schema, f"{tmp_path}/out", []
    df = spark.createDataFrame(df.collect(), schema)
    for k, (first, last) in enumerate(((0, 699), (700, 1_399), (1_400, 2_000))):
        df.filter(f"id between {first} and {last}").repartition(3).write.parquet(f"{tmp_path}/in/{k}")
        stream = held_verdicts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), "45 minutes", 1, "1 minute", groups=8)
        query = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        totals += [s["numRowsTotal"] for s in states]
    key = lambda r: (r["key"], r["id"], r["ts"], r["hit"], r["verdict"])
    order = lambda d: sorted(map(repr, map(key, d.collect())))
    got = order(spark.read.schema("key string, id long, ts timestamp, hit boolean, verdict string").parquet(f"{out}/batch=*"))
    want = order(held_verdicts_of(df, "45 minutes", 1))
    assert got == want
    assert any("True" in g for g in got) and any("False" in g for g in got)
    assert 0 < max(totals) <= 8


def test_frequent_pairs_are_found_without_sorting_all(spark, monkeypatch):
    """tasks add pairs up in bounded pieces and hand on no more than a language's share, so that one window is left."""
    from collections import Counter

    from siftmill.operators import vocabularies as V

    monkeypatch.setattr(V, "HELD_PAIRS", 7)
    rows = [("A b c_1 a b, a  b é1 é1 é1", "en"), ("a b c a b\n b a b", "en"), ("c c c c d", "de"), (None, "de"), ("x y", None), ("", "fr"), ("1 2 3 1 2", "fr")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want: Counter = Counter()
    for text, lang in rows:
        words = text.lower().split(" ") if text is not None and lang else []
        want.update((lang, f"{a} {b}") for a, b in zip(words, words[1:]) if all(w.replace("_", "a").isalnum() for w in (a, b)))
    for share in (1, 2, 50):
        terms = V.learned_terms(docs, share)
        told = sorted((r["lang"], r["term"]) for r in terms.collect())
        assert told == sorted(p for lang in ("en", "de", "fr") for p in sorted((p for p in want if p[0] == lang), key=lambda p: (-want[p], p[1]))[:share])
    assert terms._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_heads_of_an_employer_are_compared_in_blocks(spark, monkeypatch):
    """heads are not joined pair by pair to be scored in Python; twins are those of all pairs."""
    import itertools
    import random

    from siftmill.functions.similarity import token_set
    from siftmill.operators import survivorship as S

    monkeypatch.setattr(S, "BLOCK", 8)
    rng = random.Random(8)
    words = "senior data engineer python spark nurse night ward lead remote".split()
    rows = [(k, rng.choice(["acme", "acme", "beta"]), " ".join(rng.sample(words, rng.randrange(2, 9))), rng.choice(["x.com", "y.com"])) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, company_key string, head string, host string").selectExpr("*", "CAST(NULL AS STRING) AS country")
    twins = S.twin_edges(df)
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and a[3] != b[3] and (a[2] == b[2] or token_set(a[2], b[2]) >= 90)}
    assert {tuple(r) for r in twins.collect()} == want and len(want) > 50
    assert "EvalPython" not in twins._jdf.queryExecution().optimizedPlan().toString()

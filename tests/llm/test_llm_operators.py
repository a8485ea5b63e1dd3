"""Each operator against brute force, an exact library, a round trip or held-out rows, and on odd tables."""

import hashlib
import html
import itertools
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from test_collocations import brute as collocations_by_hand  # noqa: E402
from test_hard_negatives import brute as hard_negatives_by_hand  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple nutmeg oak pine".split()


def documents(spark, texts, langs=None, sources=None):
    rows = [(k, t, (langs or {}).get(k, "en"), (sources or {}).get(k, f"s{k % 3}"), None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("clash")).withColumn("id", F.lit(-1)).withColumn("score", F.lit("x"))


def odd_texts():
    rng = random.Random(4)
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    base = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(4)]
    near = [b.replace("oak", "oaks", 1) for b in base]
    return [None, "", " \t\n", "one", "One two", "one  two", *base, *near, base[0], "Alder" + base[1], long, long + " end", "12 34", "é ß Σ ς <|endoftext|> ok", "a" * 5000]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_exact_dedup_matches_brute_force(spark):
    from siftmill.llm.exact_dedup import exact_dedup

    texts = [*odd_texts(), "one two ", "x", "X", "x"]
    norm = [re.sub(r"[\x20\x09-\x0d]", "", t or "") for t in texts]
    want = []
    for k, n in enumerate(norm):
        same = [j for j, m in enumerate(norm) if m == n]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        want.append((k, keep, len(same), k == keep, hashlib.sha256(n.encode()).hexdigest()))
    for files in (None, 1):  # one micro-batch, and one for each file
        got = exact_dedup(documents(spark, texts).repartition(3), files_per_batch=files)
        assert rows(got, "id", "keep_id", "group_size", "kept", "digest") == want


def test_exact_dedup_checks_bytes_when_digests_collide(spark):
    from siftmill.llm.exact_dedup import exact_dedup

    texts = odd_texts()
    weak = exact_dedup(documents(spark, texts), digest=lambda norm: F.substring(F.sha2(norm, 256), 1, 1))
    assert rows(weak, "id", "keep_id", "group_size", "kept") == rows(exact_dedup(documents(spark, texts)), "id", "keep_id", "group_size", "kept")


def test_exact_dedup_repeated_rows_no_ids_and_no_rows(spark, tmp_path):
    from siftmill.llm.exact_dedup import exact_dedup

    docs = documents(spark, ["a b", "c"])
    got = exact_dedup(docs.union(docs))
    assert rows(got, "id", "keep_id", "group_size") == [(0, 0, 2)] * 2 + [(1, 1, 2)] * 2
    assert rows(got.filter("kept"), "id") == [(0,), (1,)]
    assert exact_dedup(docs.filter("doc_id < 0")).count() == 0
    # a row without an id wins by length only, and never takes a group with it
    bare = documents(spark, ["x y", "x y", "x  y z", "x y z", "q", "q"]).withColumn("doc_id", F.when(~F.col("doc_id").isin(0, 2, 4, 5), F.col("doc_id")))
    bare.write.parquet(f"{tmp_path}/bare.parquet")
    for source in (bare, spark.read.parquet(f"{tmp_path}/bare.parquet")):
        got = exact_dedup(source).collect()
        assert sorted((r["id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in got) == [(-1, -1, 2, False), (-1, -1, 2, True), (-1, -1, 2, True), (-1, 1, 2, False), (1, 1, 2, True), (3, -1, 2, False)]


def test_exact_dedup_of_tables_that_are_no_plain_scan(spark, tmp_path):
    from siftmill.llm.exact_dedup import exact_dedup, is_scan

    path = f"{tmp_path}/d.parquet"
    documents(spark, ["a", "b", "a"]).write.parquet(path)
    scan = spark.read.parquet(path)
    keys = spark.createDataFrame([("en",), ("en",)], "lang string")
    tables = {
        "explode": scan.select("doc_id", F.explode(F.array("text", F.lit("a"))).alias("text")),
        "union": scan.unionByName(scan),
        "join": scan.join(keys, "lang"),
        "twice": spark.read.parquet(path, path),
        "drawn": scan.sample(True, 3.0, 5),
        "limit": scan.limit(2),
        "filtered": scan.filter("doc_id > 0").withColumn("text", F.upper("text")),
        "renamed": scan.selectExpr("doc_id", "text", "lang AS _metadata"),
    }
    assert [is_scan(t) for t in tables.values()] == [False] * 6 + [True] * 2 and is_scan(scan)
    for name, df in tables.items():
        want = sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
        got = exact_dedup(df).collect()
        by_text = {}
        for doc_id, text in want:
            by_text.setdefault(text, []).append(doc_id)
        assert sorted((r["id"], r["group_size"]) for r in got) == sorted((i, len(ids)) for ids in by_text.values() for i in ids), name
        assert sum(r["kept"] for r in got) == len(by_text), name


def test_exact_dedup_locators_can_be_followed(spark, tmp_path):
    from siftmill.llm.exact_dedup import exact_dedup

    documents(spark, odd_texts()).repartition(3).write.parquet(f"{tmp_path}/d.parquet")
    for r in exact_dedup(spark.read.parquet(f"{tmp_path}/d.parquet")).collect():
        file, _, row = r["locator"].partition("#")
        assert spark.read.parquet(file).filter(F.col("_metadata.row_index") == int(row)).first()["doc_id"] == r["id"]


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from siftmill.llm.token_counts import VOCABULARY, token_counts

    rng = random.Random(2)
    pool = "aab ßΣςİıéÉé12½Ⅷ's'LL<|endoftext|>\x1c\x85\xa0日ไहि🙂-$%^\n\tthTHin ingǅﬁ"
    texts = odd_texts() + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(300)] + ["a" * k for k in range(20)]
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    want = [(k, len((t or "").encode()), n, n > 2048) for k, t in enumerate(texts) for n in [len(library.encode(t or "", add_special_tokens=False).ids)]]
    got = token_counts(documents(spark, texts), public_tokenizers.path(VOCABULARY))
    assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts(documents(spark, ["x"]).filter("doc_id < 0"), public_tokenizers.path(VOCABULARY)).count() == 0


def labelled(spark, n=400):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 80))) + "." if k % 4 else f"{rng.choice(WORDS).upper()}!! " * rng.randint(20, 60) for k in range(n)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(n)], "doc_id long, quality int, toxic int")
    return documents(spark, [*texts, None, "", "x" * 200_000]), labels


def test_quality_on_the_held_out_fold(spark):
    from siftmill.llm.quality import learn, scored

    docs, labels = labelled(spark)
    odd = labels.union(spark.createDataFrame([(1, None, None), (9999, 1, 0)], labels.schema))
    out = {r["doc_id"]: r["quality_score"] for r in scored(docs, learn(docs, odd), into="quality_score").collect()}
    assert len(out) == 403 and all(0 <= s <= 1 for s in out.values())
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all((out[k] >= 0.3) == (k % 4 > 0) for k in held)


def test_quality_does_not_learn_from_held_out_labels_and_bears_few(spark):
    from siftmill.llm.quality import FEATURES, fit, learn

    docs, labels = labelled(spark, 60)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    x = np.zeros((2, len(FEATURES)))
    assert (learn(docs, labels).score(x) == learn(docs, turned).score(x)).all()
    assert learn(docs, labels.filter("quality > 5")).score(x).tolist() == [0.5, 0.5]
    assert fit(x, np.ones(2)).score(x)[0] > 0.5


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def near_by_force(texts, width=4):
    sets, comp = [shingles(t, width) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    return [(k, len(s), c, k == c) for k, (s, c) in enumerate(zip(sets, comp, strict=True))]


def drifting(n=140, seed=5):
    """A large family of copies with growing edits, most of them alike, many just not."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 6)):
            words[at] = "new" + str(rng.randint(0, 10**6))
        out.append(" ".join(words))
    return out


def test_near_dedup_matches_brute_force(spark):
    from siftmill.llm.near_dedup import near_dedup

    texts = [*odd_texts(), *drifting(), *odd_texts()[:12]]
    for width in (4, 5):
        got = near_dedup(documents(spark, texts).repartition(4), width=width)
        assert rows(got, "id", "n_shingles", "component_id", "kept") == near_by_force(texts, width)


def test_near_dedup_no_rows_no_words_no_ids_and_repeated_ids(spark):
    from siftmill.llm.near_dedup import near_dedup

    assert near_dedup(documents(spark, ["x"]).filter("doc_id < 0")).count() == 0
    assert rows(near_dedup(documents(spark, [None, ""])), "id", "n_shingles", "component_id", "kept") == [(0, 0, 0, True), (1, 0, 1, True)]
    docs = documents(spark, ["a b c d e", "a b c d e", "a b c d e", "x"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    got = near_dedup(docs.union(docs.filter("doc_id = 2")), width=4).collect()
    assert sorted((r["id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in got) == [(-1, 2, -1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 1, 3, True)]


def test_near_dedup_of_one_id_with_several_texts(spark):
    from siftmill.llm.near_dedup import near_dedup

    rng = random.Random(6)
    a, b = (" ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(60)) for _ in range(2))
    table = [(5, a), (5, b), (6, a + " end"), (7, b + " end")]
    for order in itertools.permutations(table):
        got = near_dedup(spark.createDataFrame(list(order), "doc_id long, text string").coalesce(1))
        assert rows(got, "id", "component_id", "kept") == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False)]


def test_blocks_of_a_bucket_leave_no_pair_out(spark):
    import pyarrow as pa

    from siftmill.llm.blocks import compared

    members = spark.range(50).selectExpr("id % 2 AS bucket", "25L AS n", "id")
    pair = lambda left, right, same: pa.RecordBatch.from_arrays([pa.array([min(a, b) for a, b in p]), pa.array([max(a, b) for a, b in p])], names=["a", "b"]) if (p := [(a, b) for a in left["id"].to_pylist() for b in right["id"].to_pylist() if (a < b if same else True)]) else None
    for stripe in (1, 2, 100):
        got = rows(compared(members, [], pair, "a long, b long", block=4, stripe=stripe), "a", "b")
        assert got == [(a, b) for a, b in itertools.combinations(range(50), 2) if a % 2 == b % 2]


def test_blocks_of_a_hot_bucket_are_spread_over_the_tasks(spark):
    import pyarrow as pa

    from siftmill.llm.blocks import compared

    def count(left, right, same):
        from pyspark import TaskContext

        n = len(left["id"]) * len(right["id"])
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n])], names=["task", "n"])

    # half of all rows in one bucket, the rest in buckets of ten
    members = spark.range(8000).selectExpr("IF(id < 4000, -1, id DIV 10) AS bucket", "IF(id < 4000, 4000L, 10L) AS n", "id")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        done = compared(members, [], count, "task long, n long", block=32, stripe=4).groupBy("task").agg(F.sum("n").alias("n")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    work = [r["n"] for r in done]
    assert sum(work) >= 4000 * 4000 / 2 and len(work) == 8
    assert max(work) <= 2 * sum(work) / len(work)


def test_components_of_stars_chains_and_loops(spark):
    from siftmill.llm.components import components

    rng = random.Random(1)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (203, 201), (202, 203)] + [tuple(rng.sample(range(300, 400), 2)) for _ in range(70)]
    comp = {x: x for e in links if None not in e and e[0] != e[1] for x in e}
    for _ in range(len(comp)):
        for a, b in links:
            if a in comp and b in comp:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert rows(components(spark.createDataFrame(links, "a long, b long")), "id", "component_id") == sorted(comp.items())


def test_mixing_reaches_the_weights_and_repeats_itself(spark):
    from siftmill.llm.mixing import mixed

    docs = documents(spark, ["t"] * 3000, sources={k: "big" if k < 2000 else "small" if k < 2990 else None if k < 2995 else "" for k in range(3000)})
    out = mixed(docs, weights={"big": 1.0, "small": 2.0}, other=1.0)
    first, again = rows(out, "doc_id", "copy_no", "place"), rows(out, "doc_id", "copy_no", "place")
    assert first == again and len({p for *_, p in first}) == len(first)
    n = out.groupBy("source").count().collect()
    count = {r["source"]: r["count"] for r in n}
    assert abs(count["big"] - 750) < 120 and abs(count["small"] - 1500) < 160
    assert abs(count.get(None, 0) + count.get("", 0) - 750) < 120  # a mean of 75 for each of ten rows
    assert set(docs.columns) <= set(out.columns)
    assert mixed(docs.filter("doc_id < 0")).count() == 0


def test_mixing_carries_columns_of_any_name(spark):
    from siftmill.llm.mixing import mixed

    docs = documents(spark, ["t"] * 20 + [None, ""]).select("*", *[F.lit(k).alias(k) for k in ("mix_source", "mix_rows", "mix_rate", "mix_parts", "mix_cdf", "mix_doc", "mix_id", "rate", "Place")])
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    out = mixed(docs.union(docs.limit(2)), total=60).collect()
    assert len(out) > 20 and all(r[k] == k for r in out for k in ("mix_source", "mix_rows", "mix_rate", "mix_parts", "mix_cdf", "mix_doc", "mix_id"))
    assert all(isinstance(r["rate"], float) and len(r["place"]) == 16 for r in out)


def test_mixing_query_repeats_and_shuffles_whole_documents(spark, tmp_path):
    import glob

    from siftmill.llm.common import scratch
    from siftmill.llm.mixing import op5_mixing

    docs = documents(spark, [f"text {k} " * (400 if k % 50 == 0 else 3) for k in range(300)], sources={k: "small" if k % 50 == 0 else "big" for k in range(300)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    folder = scratch(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    before = set(glob.glob(f"{folder}/mixture-*"))
    out = op5_mixing(spark, str(tmp_path)).collect()
    (made,) = set(glob.glob(f"{folder}/mixture-*")) - before
    whole = spark.read.parquet(made)
    assert set(docs.columns) <= set(whole.columns)
    assert rows(whole, "doc_id", "copy_no", "place") == sorted((r["doc_id"], r["copy_no"], r["place"]) for r in out)
    assert [r["place"] for r in out] == sorted(r["place"] for r in out)
    assert whole.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").filter("text = t").count() == len(out) > 0


def test_mixing_draws_the_poisson_distribution(spark):
    from siftmill.llm.mixing import mixed

    docs = documents(spark, ["t"] * 4000, sources={k: "a" for k in range(4000)})
    drawn = mixed(docs, total=8000).groupBy("doc_id").count().groupBy("count").count().toDF("n", "docs").collect()
    for r in drawn:
        want = 4000 * np.exp(-2.0) * 2.0 ** r["n"] / float(np.prod(np.arange(1, r["n"] + 1)))
        assert abs(r["docs"] - want) < 6 * want**0.5 + 6


def test_packing_keeps_all_pieces_and_every_constraint(spark):
    from siftmill.llm.packing import packed

    rng = random.Random(3)
    data = [(k, f"s{rng.randint(0, 11)}" if k % 7 else None, rng.choice([None, *range(40)]), rng.choice([0, 1, 5, 60, 99, 100, 101, 250, rng.randint(1, 100)])) for k in range(800)]
    docs = spark.createDataFrame(data, "doc_id long, source string, c int, n int")
    docs = docs.union(docs.limit(3))
    out = packed(docs, F.col("n"), F.col("c"), capacity=100, shard_rows=200).toPandas()
    total = docs.agg(F.sum("n")).first()[0]
    assert out["n_tokens"].sum() == total and set(out["doc_id"]) == set(range(800))
    bins = out[out["bin_id"].notna()].merge(pd.DataFrame(data, columns=["doc_id", "_s", "c", "_n"]), on="doc_id")
    for _, b in bins.groupby("bin_id"):
        assert b["n_tokens"].sum() <= 100
        b = b.sort_values("bin_offset")
        assert b["bin_offset"].tolist() == [0, *b["n_tokens"].cumsum().tolist()[:-1]]
        assert b["c"].dropna().is_unique and b["source"].dropna().is_unique
    pieces = out.groupby(["doc_id", "start"])["n_tokens"].first()
    for k, _, _, n in data:
        assert pieces[k].to_dict() == ({0: 0} if n == 0 else {s: min(100, n - s) for s in range(0, n, 100)})
    assert packed(docs.filter("doc_id < 0"), F.col("n"), F.col("c")).count() == 0


def test_best_fit_matches_brute_force():
    from siftmill.llm.packing import best_fit

    rng = random.Random(31)
    for _ in range(60):
        n, hot = rng.randint(1, 60), rng.random() < 0.5
        sizes = sorted((rng.randint(1, 30) for _ in range(n)), reverse=True)
        sources = [1 if hot and rng.random() < 0.4 else 1 << rng.randint(0, 9) for _ in range(n)]
        clusters = [rng.choice([0, 1 << rng.randint(0, 5)]) for _ in range(n)]
        bins, offsets = best_fit(sizes, sources, clusters, 30)
        left, seen = [], []
        for size, source, cluster, b, at in zip(sizes, sources, clusters, bins, offsets, strict=True):
            free = [k for k in range(len(left)) if left[k] >= size and not seen[k][0] & source and not seen[k][1] & cluster]
            if free:
                assert left[b] == min(left[k] for k in free) and b in free
            else:
                assert b == len(left)
                left.append(30)
                seen.append((0, 0))
            assert at == 30 - left[b]
            left[b], seen[b] = left[b] - size, (seen[b][0] | source, seen[b][1] | cluster)


def test_packing_keeps_a_hot_source_apart(spark, tmp_path):
    from siftmill.llm.packing import op9_packing

    docs = documents(spark, [f"{WORDS[k % 16]} {k}" for k in range(300)] + [None, ""], sources={k: "hot" if k % 3 == 0 else f"s{k % 40}" for k in range(302)})
    docs.select("*", F.lit("x").alias("bin_id"), F.lit(1).alias("cluster"), F.lit(2).alias("total"), F.lit(3).alias("row_no"), F.lit(4).alias("shard")).write.parquet(f"{tmp_path}/documents.parquet")
    out = op9_packing(spark, str(tmp_path)).toPandas()
    assert len(out) == 302 and out["bin_id"].isna().sum() == 2
    packed = out[out["bin_id"].notna()]
    assert not packed.duplicated(["bin_id", "source"]).any() and packed["bin_id"].nunique() == 100


def test_best_fit_takes_the_tightest_compatible_bin():
    from siftmill.llm.packing import best_fit

    assert best_fit([7, 6, 3, 2], [0, 0, 0, 0], [0, 0, 0, 0], 10) == ([0, 1, 0, 1], [0, 0, 7, 6])
    assert best_fit([7, 6, 3, 2], [0, 0, 0, 0], [1, 0, 1, 0], 10) == ([0, 1, 1, 0], [0, 0, 6, 7])
    assert best_fit([5, 5], [1, 1], [0, 0], 10) == ([0, 1], [0, 0])


def pages(spark, htmls):
    data = [(k, None if k == 2 else f"http://x.org/{k}\r\nä", h) for k, h in enumerate(htmls)]
    return spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("text", F.lit("clash"))


def test_warc_round_trip(spark):
    from siftmill.llm.common import scratch
    from siftmill.llm.warc import archived, read_archives

    big, small = "<p>é\r\n\r\nWARC/1.1</p>" * 30, "x" * 99
    htmls = [None, "", big, small, small, big, "y" * 100, "y" * 100, "z" * 300_000, big]
    made = pages(spark, htmls)
    bare = read_archives(archived(made.filter("page_id >= 5").withColumn("page_id", F.when(F.col("page_id") > 5, F.col("page_id"))), scratch(spark, "warc"))).collect()
    assert sorted((r["page_id"] or -1, r["refers_to"]) for r in bare if r["payload_bytes"] == len(big.encode())) == [(-1, None), (9, None)] and len(bare) == 5
    back = {r["page_id"]: r for r in read_archives(archived(made.repartition(3), scratch(spark, "warc")), with_payload=True).collect()}
    assert len(back) == len(htmls)
    for k, h in enumerate(htmls):
        raw = (h or "").encode()
        first = min(j for j, g in enumerate(htmls) if (g or "").encode() == raw)
        revisit = len(raw) >= 100 and first != k
        r = back[k]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
        assert r["payload"] is None if revisit else bytes(r["payload"]) == raw
    assert back[2]["url"] is None
    assert archived(made.filter("page_id < 0"), scratch(spark, "warc")).count() == 0
    assert read_archives(archived(made.filter("page_id < 0"), scratch(spark, "warc"))).count() == 0
    assert len(read_archives(archived(made.union(made), scratch(spark, "warc"))).collect()) == 2 * len(htmls)


def test_warc_reader_notices_damage():
    import io

    from siftmill.llm.warc import members, page_record, parsed, payload_of

    good = page_record(1, "http://a", b"abc" * 100, hashlib.sha256(b"abc" * 100).hexdigest(), None, "2024-01-01T00:00:00Z")
    assert payload_of(parsed(next(members(io.BytesIO(good + good), 7)))) == (300, b"abc" * 100)
    assert len(list(members(io.BytesIO(good + good), 7))) == 2
    with pytest.raises(ValueError):
        list(members(io.BytesIO(good + good[:-20])))
    plain = zlib.decompress(good, 31)
    for bad in (plain.replace(b"abcabc", b"abcabd", 1), plain[:-5], plain.replace(b"WARC/1.1", b"warp/1.1", 1)):
        with pytest.raises(ValueError):
            parsed(bad)


def test_embedding_dedup_matches_brute_force(spark):
    from siftmill.llm.embedding_dedup import embedding_dedup

    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    vectors = [b + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.25]) for b in base for _ in range(5)]
    vectors = [v.tolist() for v in vectors] + [base[0].tolist()] * 6 + [(base[1] * 1e200).tolist(), (base[1] * 1e-200).tolist()]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, base[2][:8].tolist(), base[2][:8].tolist()]
    data = [(k, v, None if k % 41 == 40 else k % 2) for k, v in enumerate([*vectors, *odd])]
    got = embedding_dedup(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit("clash")))

    def usable(v, label):
        return label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)

    links, comp = [0] * len(data), list(range(len(data)))
    for (i, v, a), (j, w, b) in itertools.combinations(data, 2):
        if a == b and usable(v, a) and usable(w, b) and len(v) == len(w):
            x, y = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    want = [(k, n, c, k == c) for k, (n, c) in enumerate(zip(links, comp, strict=True))]
    out = rows(got, "id", "n_links", "component_id", "kept")
    assert sum(o[1] for o in out) >= 0.9 * sum(links)
    assert out == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert embedding_dedup(empty).count() == 0


def test_embedding_dedup_finds_the_links_of_a_hot_group(spark):
    from siftmill.llm.embedding_dedup import embedding_dedup

    rng = np.random.default_rng(7)
    n, hot = 10_000, 3333
    centre = rng.normal(size=64)
    v = rng.normal(size=(n, 64))
    v[:hot] = centre + v[:hot] * np.sqrt(1 / 0.94 - 1) * np.sqrt(centre @ centre / 64)
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    order = rng.permutation(n)
    v = v[order]
    linked = v @ v.T >= 0.93
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": v.tolist(), "label": 1}), "vec_id long, embedding array<double>, label int")
    out = embedding_dedup(table).toPandas().sort_values("id")
    links = out["n_links"].to_numpy()
    assert np.all(links <= linked.sum(axis=1))
    assert links.sum() >= 0.99 * linked.sum() > 0
    first = np.flatnonzero(order < hot).min()
    assert np.all(out["component_id"].to_numpy()[(order < hot) & (links > 0)] == first)


@pytest.mark.parametrize("share", [0.90, 0.93, 0.95])
def test_embedding_dedup_where_all_vectors_have_a_common_direction(spark, share):
    from siftmill.llm.embedding_dedup import embedding_dedup

    rng = np.random.default_rng(12)
    n, width = 3000, 64
    common, own = rng.normal(size=width), rng.normal(size=(n, width))
    v = common / np.sqrt(common @ common) * np.sqrt(share) + own / np.sqrt((own * own).sum(axis=1, keepdims=True)) * np.sqrt(1 - share)
    v[2000:] = own[2000:]  # the third label has no links
    label = np.r_[np.zeros(1500, dtype=int), np.ones(500, dtype=int), np.full(1000, 2)]
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": v.tolist(), "label": label}), "vec_id long, embedding array<double>, label int")
    out = embedding_dedup(table.union(table.filter("vec_id < 0"))).toPandas().sort_values("id")
    want = linked.sum(axis=1)
    assert want.sum() > 0 and np.all(out["n_links"].to_numpy() <= want)
    assert out["n_links"].sum() >= 0.99 * want.sum()


MENU = '<ul class="menu"><li><a href="/a">{s}</a></li><li><a href="/b">{s}</a></li><li><a href="/c">{s}</a></li></ul>'
LAYOUTS = (
    f'<body><header class="site-header"><div class="logo">{{s}}</div>{MENU}</header><div id="content" data-label="1"><h1>{{s}}</h1><p>{{p}}</p><p>{{p}}</p><h2>{{s}}</h2><p>{{p}}</p></div><div class="sidebar" data-label="0"><h3>{{s}}</h3><p>{{p}}</p>{MENU}</div><div class="footer">&copy; {{s}}</div></body>',
    f'<body>{MENU}<div class="cookie-notice"><p>{{p}}</p><button>{{s}}</button></div><main><div class="post-body entry-content" data-label="1"><h1>{{s}}</h1><p>{{p}}</p><ul><li>{{p}}</li><li>{{p}}</li></ul><p>{{p}}</p></div><section id="comments"><h3>Comments</h3><div class="comment"><p>{{p}}</p></div><div class="comment"><p>{{p}}</p></div><form><label>{{s}}</label><button>Reply</button></form></section></main><footer><p>{{p}}</p></footer></body>',
    f'<body><div class="banner ad"><p>{{p}}</p></div><div class="nav">{MENU}</div><div class="article-text story" data-label="1"><p>{{p}}</p><blockquote>{{p}}</blockquote><div class="advert" data-label="0"><p>{{p}}</p></div><p>{{p}}</p></div><div class="related share" data-label="0">{MENU}</div><div class="newsletter"><p>{{p}}</p><form><input name="m"><button>{{s}}</button></form></div></body>',
    f'<body><div role="navigation">{MENU}</div><div role="main" data-label="1"><h1>{{s}}</h1><div>{{p}}</div><div>{{p}}</div><table><tr><td>{{p}}</td><td>{{p}}</td></tr></table></div><aside><p>{{p}}</p></aside><div role="contentinfo"><p>{{s}}</p></div></body>',
    f'<body><header><nav>{MENU}</nav></header><article data-label="1"><h1>{{s}}</h1><p>{{p}}</p><aside class="promo" data-label="0"><p>{{p}}</p></aside><p>{{p}}</p><p>{{s}}</p><footer data-label="0"><p>{{s}}</p></footer></article><section class="comments" data-label="0"><p>{{p}}</p><p>{{p}}</p></section><footer>{{s}}</footer></body>',
    f'<body><div class="alert notice"><p>{{p}}</p></div><table><tr><td class="left">{MENU}</td><td class="text" data-label="1"><p>{{p}}</p><p>{{p}}</p><p>{{s}}</p></td></tr></table><p class="copyright">&copy; {{s}}</p></body>',
    f'<body><div>{MENU}</div><div data-label="1"><h1>{{s}}</h1><p>{{p}}</p><p>{{p}}</p><p>{{p}}</p></div><div><a href="/x">{{s}}</a> <a href="/y">{{s}}</a></div><div class="respond"><h3>{{s}}</h3><form><p>{{s}}</p></form></div></body>',
    f'<body><nav>{MENU}</nav><article data-label="1"><h1>{{s}}</h1><p>{{p}}</p><p>{{p}}</p><section id="comments" data-label="0"><h3>Comments</h3><p>{{p}}</p><p>{{p}}</p></section></article></body>',
    '<html><head><title>{s}</title></head><body data-label="1"><div class="c1"><div class="c2"><p>{p}</p><p>{p}</p></div><div class="c2">{p}</div></div></body></html>',
    '<body><div class="m7" data-label="0"><a href="/">{s}</a><a href="/b">{s}</a><a href="/c">{s}</a></div><div class="m8" data-label="1"><p>{p}</p><p>{p}</p><p>{p}</p></div><div class="m9" data-label="0">Copyright {s}</div></body>',
    '<body data-label="1"><p>{p}</p><p>{p}</p><noscript><p>{p}</p></noscript><object><p>{p}</p></object></body>',
)

def laid_out(paragraphs, pages, seed):
    """Pages of fixed layouts: {p} takes a paragraph, {s} a short phrase; data-label marks the article."""
    rng = random.Random(seed)
    short = lambda _: " ".join(rng.choice(paragraphs).split()[: rng.randint(1, 6)])
    return [re.sub(r"\{s\}", short, re.sub(r"\{p\}", lambda _: rng.choice(paragraphs), LAYOUTS[k % len(LAYOUTS)])) for k in range(pages)]


def articles():
    sentences = [f"The {a} and the {b} stand near the old {c}, and nobody asks why. They were there before." for a, b, c in itertools.permutations(WORDS[:7], 3)]
    real = [f"<body><nav><a href=/>{WORDS[k % 9]}</a></nav><article><h1>{WORDS[k % 8]}</h1>" + "".join(f"<p>{s}</p>" for s in sentences[k : k + 4]) + f"</article><footer>&copy; {WORDS[k % 5]}</footer>" for k in range(60)]
    return sentences, real


@pytest.fixture(scope="module")
def page_model():
    from siftmill.llm.html_extract import fit

    return fit(articles()[1][:40])


def test_embedding_dedup_loses_no_link_of_many_small_labels(spark):
    from siftmill.llm.embedding_dedup import embedding_dedup

    rng = np.random.default_rng(7)
    data = []
    for label in range(500):
        a = rng.normal(size=24)
        b = rng.normal(size=24)
        a, b = a / np.linalg.norm(a), b - (a @ b) / (a @ a) * a
        b = 0.932 * a + np.sqrt(1 - 0.932**2) * b / np.linalg.norm(b)
        data += [(2 * label, a.tolist(), label), (2 * label + 1, b.tolist(), label)]
    got = embedding_dedup(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), queries=50)
    assert {(r["id"], r["n_links"], r["component_id"]) for r in got.collect()} == {(k, 1, k - k % 2) for k in range(1_000)}



def test_html_blocks_and_held_out_layouts(spark, page_model):
    from siftmill.llm.html_extract import blocks, extracted

    page = "<html><body><nav><a href=/a>Home</a></nav><article><h1>A &amp; B</h1><p>One\n  two<br>three &eacute;<b>bold</b><p>Four<!-- no --><script>var x='<p>no</p>'</script></article><footer>&copy; x</footer>"
    assert [b.text for b in blocks(page)] == ["Home", "A & B", "One two three ébold", "Four", "© x"]
    sentences, real = articles()
    for made in (real[40:], laid_out(sentences, 4 * len(LAYOUTS), seed=99)):
        data = pages(spark, [*made, None, "", "<p", "<!-- open", "<div>" * 3000])
        got = {r["page_id"]: r["main"] for r in extracted(data, page_model, into="main").collect()}
        right = hit = taken = asked = 0
        for k, h in enumerate(made):
            want = [b.text for b in blocks(h) if (b.label == 1 if "data-label" in h else "in:article" in b.above)]
            right += got[k] == "\n\n".join(want)
            found = got[k].split("\n\n") if got[k] else []
            hit, taken, asked = hit + len(set(want) & set(found)), taken + len(set(found)), asked + len(set(want))
        assert right >= 0.85 * len(made) and hit >= 0.95 * taken and hit >= 0.95 * asked
        assert [got[len(made) + k] for k in range(2)] == ["", ""]


def test_html_depth_plain_text_and_long_names(page_model):
    from siftmill.llm.html_extract import blocks

    (a, b, *_), _ = articles()
    assert page_model.extract([a + "\n\n" + b, f"<p>{a}</p><p>{b}</p>"]) == [f"{a} {b}", f"{a}\n\n{b}"]
    for depth in (198, 250, 5000):
        page = "<div>" * depth + f"<article><p>{a}</p><p>{b}</p></article>" + "</div>" * depth + "<footer>&copy; x</footer>"
        assert page_model.extract([page]) == [f"{a}\n\n{b}"]
        assert not any(f.startswith("in:div") for f in blocks(page)[-1].above)
    assert "name:comments" in blocks('<div class="' + "x " * 20 + 'comments"><p>t</p></div>')[0].above
    assert [x.text for x in blocks("<noscript>one</noscript><p>two <math><mi>x</mi></math></p><video>three</video><textarea>no</textarea>")] == ["one", "two x", "three"]


def test_html_query_on_a_table_and_on_none(spark, tmp_path):
    from siftmill.llm.html_extract import op8_html_extract

    _, real = articles()
    table = pages(spark, [*real, None, ""]).union(pages(spark, real[:1]))
    table.write.parquet(f"{tmp_path}/pages.parquet")
    want = {k: "\n\n".join(re.findall(r"<(?:h1|p)>([^<]*)<", h)) for k, h in enumerate(real)} | {60: "", 61: ""}
    got = op8_html_extract(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == sorted((k, t, len(t)) for k, t in [*want.items(), (0, want[0])])
    table.filter("page_id < 0").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op8_html_extract(spark, f"{tmp_path}/none").count() == 0


def test_html_extraction_of_random_layouts(page_model):
    from collections import Counter

    from siftmill.llm.html_extract import blocks, filled

    made = filled(articles()[0], 120, seed=123)
    hit = found = want = 0
    for (page, rest), text in zip(made, page_model.extract([p for p, _ in made]), strict=True):
        a, b = Counter(x.text for x in blocks(page, rest) if x.label), Counter(text.split("\n\n") if text else [])
        hit, found, want = hit + (a & b).total(), found + b.total(), want + a.total()
    assert hit >= 0.93 * found and hit >= 0.93 * want


def test_html_tokenizer_is_linear_in_broken_pages():
    import time

    from siftmill.llm.html_extract import blocks

    began = time.time()
    for piece in ('<a "', "<", "<!--", "<!x", "<div>", "</p>", "<div></p>", "<div>x", "<script>", "<p class='", "<b =", "</div", "&lt"):
        blocks(piece * 40_000)
    assert time.time() - began < 60


def test_language_of_words_and_texts(spark):
    from siftmill.llm.langid import learn, recognised

    rng = random.Random(8)
    speech = {"aa": ["tha", "ing", "the", "ow"], "bb": ["che", "ung", "lich", "ö"], "cc": ["ci", "ña", "ado", "os"]}
    say = lambda lang, n: " ".join("".join(rng.choice(speech[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    langs = {k: list(speech)[k % 3] for k in range(240)}
    texts = [say(langs[k], 40) for k in range(240)] + [None, "", "12 ½ !", say("aa", 60) + " " + say("bb", 20), say("cc", 20_000)]
    docs = documents(spark, texts, langs=langs | {242: None})
    out = recognised(docs.withColumn("found", F.lit("mine")), learn(docs.filter("doc_id < 240"))).collect()
    assert all(r["found"] == "mine" for r in out)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert [got[k] for k in (240, 241, 242)] == [("und", 0.0)] * 3
    assert got[243][0] == "aa" and 0.5 < got[243][1] < 0.95 and got[244][0] == "cc"
    assert sum(got[k][0] == langs[k] for k in range(240)) >= 235
    assert learn(docs.filter("doc_id < 0")).languages == []
    nobody = recognised(docs, learn(docs.filter("doc_id < 0")))
    assert {(r["lang_pred"], r["score"]) for r in nobody.collect()} == {("und", 0.0)} and nobody.filter("doc_id < 0").count() == 0


def test_language_needs_letters_and_reads_whole_runs(spark):
    from siftmill.llm.langid import Recogniser, fit, learn, words_of

    assert [words_of(t) for t in ("½ ½ ½ ½", "²²²² ³³ ¹¹¹ ½", "12 _ !", None, "")] == [[]] * 5
    assert words_of("x² Ab½c é1") == ["x", "ab", "c", "é"]
    run = "abcdefghij" * 30
    assert "".join(words_of(run)) == run and len(words_of(run)) == 10
    model = fit(["tha the ing ow " * 20, "che ung lich "*20], ["aa", "bb"])
    texts = ["tha " * 40 + "lich " * 30, "½ ½ ½ ½", "the " * 200_000, "the lich"]
    got = Recogniser(model).predict(texts)
    assert got[0][0] == "aa" and got[1] == ("und", 0.0) and got[2][0] == "aa" and got[3][0] in ("aa", "bb")
    tie = fit(["same words here", "same words here"], ["bb", "aa"])
    assert Recogniser(tie).predict(["words"])[0] == Recogniser(tie).predict(["words"])[0]
    # a repeated id brings no more rows than asked for
    docs = documents(spark, ["the ow"] * 50, langs={k: "aa" for k in range(50)}).withColumn("doc_id", F.lit(2))
    assert set(learn(docs, sample=5).languages) == {"aa"}


def test_viterbi_and_marginals_match_enumeration():
    from siftmill.llm.crf import Chain, forward_backward, viterbi

    rng = np.random.default_rng(1)
    chain = Chain(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = np.array([4, 1, 3])
    emissions = rng.normal(size=(lengths.sum(), 3))
    gamma, best, at = forward_backward(chain, emissions, lengths), viterbi(chain, emissions, lengths), 0
    for n in lengths:
        e = emissions[at : at + n]
        paths = list(itertools.product(range(3), repeat=n))
        score = np.array([chain.start[p[0]] + sum(e[t, p[t]] for t in range(n)) + sum(chain.moves[a, b] for a, b in itertools.pairwise(p)) for p in paths])
        weight = np.exp(score) / np.exp(score).sum()
        assert tuple(best[at : at + n]) == paths[int(score.argmax())]
        for t in range(n):
            assert np.allclose(gamma[at + t], [sum(w for p, w in zip(paths, weight, strict=True) if p[t] == k) for k in range(3)])
        at += n


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 120)
    docs = docs.select(*[c.split()[0] for c in DOCS.split(", ")]).union(spark.createDataFrame([(900 + k, t, "en", "s0", 1) for k, t in enumerate(drifting(30) + drifting(3)[:3])], DOCS))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    here, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, here, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        here = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append(here.toPandas())
        if k < 4:
            assert list(seen[k].columns) == [c.split()[0] for c in DOCS.split(", ")]
    quality, exact, near, mix, pack = seen
    assert {k for k in range(120) if k % 4 == 0} & set(quality["doc_id"]) == set() and {k for k in range(120) if k % 4} <= set(quality["doc_id"])
    norm = exact["text"].fillna("").str.replace(r"[\x20\x09-\x0d]", "", regex=True)
    assert norm.is_unique and set(norm) == set(quality["text"].fillna("").str.replace(r"[\x20\x09-\x0d]", "", regex=True))
    ordered = exact.sort_values("doc_id")
    force = near_by_force(ordered["text"].tolist(), 5)
    assert sorted(near["doc_id"]) == [d for d, f in zip(ordered["doc_id"], force, strict=True) if f[3]]
    assert set(mix["doc_id"]) <= set(near["doc_id"]) and mix["doc_id"].value_counts().to_dict() == pack[pack["start"] == 0]["doc_id"].value_counts().to_dict()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pack)


def odd_tables(spark, folder, empty):
    """The four tables with nulls in every column, repeated rows, and columns whose names the operators use themselves."""
    rng = random.Random(40)
    clash = [F.lit(k).alias(k) for k in ("id", "score", "kept", "digest", "found", "place", "quality_score", "locator", "bin_id", "n_tokens", "component_id", "labels", "html_text")]
    say = lambda: " ".join(rng.choice(WORDS) for _ in range(30)) + "."
    docs = [(k, say() if k % 4 else f"{rng.choice(WORDS).upper()}!! " * 30, "en" if k % 2 else "de", f"s{k % 3}", None) for k in range(60)]
    docs += [(None, say(), None, None, None), (60, None, "en", "s0", 1), (61, "", None, None, None), docs[1], docs[1], (62, docs[1][1], "en", "s1", 2), (None, docs[1][1], "en", None, None)]
    tables = {
        "documents": spark.createDataFrame(docs, DOCS),
        "labels": spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(60)] + [(None, 1, 0), (1, None, None), (1, 1, 1)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(k, f"http://x/{k}", f"<article><p>{say()}</p></article>") for k in range(12)] + [(None, None, None), (12, "", ""), (3, "http://x/3", "<p>again")], "page_id long, url string, html string"),
        "embeddings": spark.createDataFrame([(k, [rng.random() for _ in range(4)], k % 2) for k in range(20)] + [(None, [1.0] * 4, 1), (20, None, None), (21, [0.0] * 4, 1)], "vec_id long, embedding array<float>, label int"),
    }
    for name, df in tables.items():
        (df.filter(F.lit(not empty))).select("*", *[c for c in clash]).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return {name: 0 if empty else df.count() for name, df in tables.items()}


@pytest.mark.parametrize("empty", [True, False])
def test_every_query_on_odd_and_empty_tables(spark, tmp_path, empty):
    from siftmill.llm.registry import QUERIES

    n = odd_tables(spark, tmp_path, empty)
    reads = {"op6_warc": "pages", "op8_html_extract": "pages", "op7_embedding_dedup": "embeddings"}
    for name, query in QUERIES.items():
        out = query(spark, str(tmp_path)).collect()
        if name == "op11_hard_negatives":  # anchor 0 is of label 0 + 1, as 7 and 14 are moved
            rows_ = [] if empty else [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [math.floor(256 * x) for x in r["embedding"]]) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").collect()]
            assert sorted(tuple(r) for r in out) == hard_negatives_by_hand(rows_, lambda i: i % 100 == 0), name
        elif name == "op13_collocations":
            rows_ = [] if empty else [(r["text"], r["lang"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
            assert sorted(tuple(r) for r in out) == collocations_by_hand(rows_, 30, 80, 2_000), name
        elif name not in ("op5_mixing", "op9_packing"):
            assert len(out) == n[reads.get(name, "documents")], name
        elif empty:
            assert not out, name
        else:
            assert {r["doc_id"] for r in out} <= {*range(63), None} and len(out) > 30, name


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, empty):
    import corpus_pipeline

    odd_tables(spark, tmp_path, empty)
    here = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = here.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, here, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        here = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert here.columns == names and here.filter("quality_score <> 'quality_score' OR place <> 'place'").count() == 0
    assert (here.count() == 0) == empty


def test_html_parts_by_other_names(spark, page_model):
    paragraphs = [max(r["text"].split("\n"), key=len) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 400").select("text").limit(240).collect()]
    rng = random.Random(3)
    parts = {
        "reviews": '<div class="user-reviews"><h2>Reader reviews</h2><p>{0}</p><p>{1}</p></div>',
        "opinions": '<div class="opinions"><div><b>Ann</b><p>{0}</p></div><div><b>Bo</b><p>{1}</p></div></div>',
        "partner": '<div class="partner"><p>{0}</p><p>{1}</p></div>',
        "widget": '<div class="OUTBRAIN"><p>{0}</p><p>{1}</p></div>',
        "dialog": "<dialog open><p>{0}</p><p>{1}</p></dialog>",
    }
    pages, want = [], []
    for part in parts.values():
        for k in range(40):
            own, other = rng.sample(paragraphs, 4), rng.sample(paragraphs, 2)
            body, apart = [f"<p>{html.escape(p)}</p>" for p in own], part.format(*map(html.escape, other))
            inside = "".join([*body[:2], apart, *body[2:]] if k % 2 else body)
            pages.append(f"<html><body><nav><a href=/>home</a></nav><article>{inside}</article>{'' if k % 2 else apart}</body></html>")
            want.append((set(own), set(other)))
    got = page_model.extract(pages)
    kept = sum(" ".join(p.split()) in text for text, (own, _) in zip(got, want, strict=True) for p in own)
    stayed = sum(" ".join(p.split()) in text for text, (own, other) in zip(got, want, strict=True) for p in other - own)
    assert kept >= 0.97 * 4 * len(pages) and stayed <= 0.05 * 2 * len(pages), (kept, stayed)

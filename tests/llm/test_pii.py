"""Personal data: the base spans against the plain patterns, propagation against enumeration, and what the field adds."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.llm import pii


def plain(text):
    """The contract's patterns as they are written, by Python's own search."""
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def sentences(rng, n):
    pieces = ["a", "@", ".", "1", "25", "256", "0", "+", "-", " ", "(", ")", "x.y", "é", "😀", "@b.c", "1.2.3.4", "4111111111111111", "4111 1111-1111 1111", "+1 (017) 555-7713", "u.v@w-1.example.com", "\n", "%", "_", "00000000000000", "٣"]
    return ["".join(rng.choices(pieces, k=rng.randrange(0, 14))) for _ in range(n)]


def test_base_spans_are_those_of_the_plain_patterns():
    for text in [*sentences(random.Random(5), 30_000), "a@b.c@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8.9", "+1+2 3456789012", "000.1.2.3 0256.1.1.1"]:
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_read_in_linear_time():
    began = time.time()
    for text in ["a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "+1" * 500_000, "@" * 300_000, "a@" * 300_000, "1 " * 200_000, "[at] " * 20_000, "(" * 500_000]:
        pii.base_spans(text)
        pii.tokens(text)
    assert time.time() - began < 60


def test_propagation_is_exact_on_trees():
    rng = np.random.default_rng(1)
    edges = np.array([(0, 1, 0), (1, 2, 0), (1, 3, 1), (3, 4, 2)])
    unary, tables = rng.normal(size=(5, 3)), rng.normal(size=(3, 3, 3))
    total = np.zeros((5, 3))
    for y in itertools.product(range(3), repeat=5):
        p = np.exp(sum(unary[k, y[k]] for k in range(5)) + sum(tables[t, y[i], y[j]] for i, j, t in edges))
        for k in range(5):
            total[k, y[k]] += p
    got, _ = pii.messages(unary, edges, tables, 40)
    assert np.allclose(np.exp(got - pii.log_sum(got, 1)[:, None]), total / total.sum(axis=1, keepdims=True), atol=1e-6)


def corpus(n, seed):
    rng = random.Random(seed)
    words = "was gesagt the oak of wine nous avons hier del camino tower".split()
    def mention():
        kind = rng.randrange(4)
        if kind == 0:
            return f"{rng.choice(words)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"
        if kind == 1:
            return ".".join(str(rng.randrange(256)) for _ in range(4))
        if kind == 2:
            d = "4" + "".join(rng.choices("0123456789", k=14))
            return next(d + str(k) for k in range(10) if pii.luhn(d + str(k)))
        return f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    return [" ".join([*rng.choices(words, k=8), mention(), *rng.choices(words, k=30), *([mention()] if rng.random() < 0.5 else []), *rng.choices(words, k=5)]) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return pii.fit(*pii.labelled([pii.condensed(t) for t in corpus(500, 3)]))


def added(model, text, sure=0.9):
    graph = pii.Graph()
    pii.add_document(graph, text, model)
    return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.added_spans(graph, model.marginals(graph), [pii.base_spans(text)], np.zeros(len(graph.starts), dtype=int), sure)[0]]


def test_other_forms_are_found_in_held_out_texts(model):
    rng, found, missed, wrong = random.Random(8), 0, 0, []
    for text in corpus(300, 77):
        taught, want = pii.lesson(text, rng)
        base = pii.base_spans(taught)
        need = {(pii.KINDS[k], taught[a:b]) for a, k, b in want if not any(s < b and a < e for s, _, e in base)}
        got = set(added(model, taught))
        found, missed, wrong = found + len(need & got), missed + len(need - got), wrong + sorted(got - need)
    assert found >= 0.9 * (found + missed) and found > 200
    assert len(wrong) <= 0.03 * found, wrong


def test_clean_texts_stay_clean(model):
    rng = random.Random(4)
    assert not [x for t in corpus(50, 5) for x in added(model, t)]
    texts = [" ".join(f"{rng.choice(['oak', 'wine', 'of', 'hier'])} {pii.nobodys(rng)}" for _ in range(12)) for _ in range(200)]
    assert sum(len(added(model, t)) for t in texts) <= 8  # of 2,400 numbers


def test_a_sure_mention_makes_a_distant_one_surer(model):
    text = "call {} said the oak " + "of wine and so on " * 30 + "then {} was out"
    number = "5557713"
    def kind_of_last(first):
        graph = pii.Graph()
        pii.add_document(graph, text.format(first, number), model)
        return float(model.marginals(graph)[-1][[7, 8]].sum())
    doubtful = kind_of_last("+1 (017) 555-9999")  # other digits: no edge
    assert doubtful == pytest.approx(kind_of_last("nobody"), abs=1e-9)
    assert kind_of_last("+1 (017) 555-7713") > 5 * doubtful


def test_edges_grow_with_the_tokens():
    graph = pii.Graph()
    pii.add_document(graph, "5551234567 x " * 5_000)
    assert len(graph.edges) <= 2 * 5_000


def test_pii_query(spark, tmp_path):
    texts = [None, "", " \n", *corpus(120, 9), *sentences(random.Random(2), 80), "x" * 30_000 + " 10.0.0.1 " + "y" * 30_000, "mail o.k.7 [at] mail3 [dot] example [dot] com or o.k.7@mail3.example.com"]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[5]])), "doc_id long, text string").withColumn("pii", F.lit("clash")).withColumn("spans", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op12_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) + 1
    for k, text in enumerate([*texts, texts[5]]):
        base, r = plain(text or ""), got[k]
        assert [r[f"n_{x}"] for x in pii.KINDS] == [sum(s[1] == j for s in base) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        spans = [] if not r["spans"] else [x.split(":") for x in r["spans"].split(",")]
        assert {(int(a), pii.KINDS.index(x), int(b)) for x, a, b in spans} >= set(base) and len(spans) == len(base) + r["n_added"]
    docs.filter("doc_id < 0").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pii.op12_pii(spark, f"{tmp_path}/none").count() == 0

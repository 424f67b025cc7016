"""Frequent keys in shares, several groups a task, disclosing terms and the pipeline on awkward tables."""

import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.llm import common, decontaminate, lm_score, near_dup, packing, personal_data, quality

from . import brute
from .test_llm import BYTES, DATA, by_id, docs, empty, odd, odd_texts, texts  # noqa: F401


def test_shares_lose_and_repeat_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    own = [(i, i % 4 if i % 3 else 9) for i in range(300)] + [(300, 77), (301, None)]
    n = Counter(k for _, k in own)
    rows = spark.createDataFrame([(x, k, n[k]) for x, k in own], "x int, k int, n int")
    values = spark.createDataFrame([(k, v, n[k]) for k in (0, 1, 2, 3, 9) for v in "ab"], "k int, v string, n int")
    got = common.in_shares(rows, values, ["k"], "n", ["x"])
    assert sorted(got.columns) == ["k", "v", "x"]
    assert sorted(map(tuple, got.select("x", "k", "v").collect())) == sorted((x, k, v) for x, k in own if k is not None and k < 10 for v in "ab")
    assert common.in_shares(rows.where("false"), values, ["k"], "n", ["x"]).count() == 0


def test_frequent_keys_are_few(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    counts = spark.createDataFrame([(k, 1 + k % 50) for k in range(1000)], "k int, n long")
    for most in (0, 5, 40, 10**6):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        got = common.frequent(counts, "k", "n").collect()
        assert len(got) <= most and all(r["n"] > 10 for r in got)
    assert len(got) == sum(1 + k % 50 > 10 for k in range(1000))
    assert common.frequent(counts.where("false"), "k", "n").count() == 0


def test_passages_of_common_words(spark, monkeypatch):
    """Windows whose rarest word is in every document, with too many windows to broadcast."""
    rnd = random.Random(3)
    rows = {i: " ".join(rnd.choice("the of and".split()) for _ in range(60)) for i in range(40)}
    items = {k: " ".join(rnd.choice("the of and".split()) for _ in range(rnd.choice([4, 7, 12]))) for k in range(12)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    got = by_id(decontaminate.digest(decontaminate.find_passages(df, bench)))
    want = brute.passages(rows, items)
    assert {i: tuple(got[i])[1:] for i in want} == want and any(x[-1] for x in want.values())


def test_near_duplicates_of_frequent_buckets(spark, monkeypatch):
    """Buckets in shares, and families of which every band has the same members."""
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    monkeypatch.setattr(near_dup, "PAIRS_UP_TO", 4)
    monkeypatch.setattr(near_dup, "BLOCK", 10)
    rnd = random.Random(5)
    rows = {}
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(120)]
        for _ in range(40):
            w = list(base)
            for k in rnd.sample(range(120), rnd.randrange(0, 6)):
                w[k] = f"n{rnd.randrange(10**6)}"
            rows[len(rows)] = " ".join(w)
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")))
    for i, (n, least) in brute.components(rows).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, least, i == least)


def _disclosing(rows, support=3, share=0.9):
    """From probabilities: terms whose mutual information with an address is at least a share of its information."""
    seen = set(rows)
    holds, near, said = Counter(), Counter(), Counter()
    for text in seen:
        tokens = text.split(" ")
        terms = {t for t in tokens if t.isalpha() and len(t) >= 4}
        said.update(terms)
        together = {(tokens[i], t) for i in range(len(tokens)) if "@" in tokens[i] for t in tokens[max(0, i - 5) : i] + tokens[i + 1 : i + 6] if t in terms}
        near.update(together)
        holds.update({t for t in tokens if "@" in t})
    p = lambda c: c / len(seen)
    out = set()
    for (entity, term), both in near.items():
        if min(both, holds[entity]) >= support and holds[entity] < len(seen):
            gain = math.log(p(both) / (p(max(said[term], both)) * p(holds[entity])))
            if gain >= share * -math.log(p(holds[entity])):
                out.add((term, entity))
    return out


@pytest.mark.parametrize("most", [200_000, 2])
def test_disclosing_terms_against_brute_force(spark, monkeypatch, most):
    """Random company, copies of texts, a term near every address; with and without broadcasts."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rnd = random.Random(8)
    common_words = [f"plain{c}" for c in "abcdefghijkl"]
    rows = []
    for i in range(400):
        who = rnd.randrange(12)
        w = [rnd.choice(common_words) for _ in range(rnd.randrange(4, 14))]
        if i % 2:
            at = rnd.randrange(len(w))
            w[at:at] = ["contact"] * rnd.randrange(2) + [f"u{who}@corp.example.com"] + [f"nick{chr(97 + who)}"] * rnd.randrange(2)
        rows.append(" ".join(w))
    rows += rows[1:200:20] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = common.cut(personal_data.scan(df))
    got = {tuple(r) for r in personal_data.disclosing_terms(df, found).collect()}
    want = _disclosing(rows)
    assert got == want and len(want) >= 5


def test_packing_follows_the_curve(spark, docs, texts, monkeypatch):  # noqa: F811
    """Within a range documents come by curve key, and ranges divide the keys."""
    import pyarrow as pa

    monkeypatch.setattr(packing, "RANGE_BYTES", 100_000)
    ids = sorted(texts)
    key = {}
    for i, j, raw, off in packing.chunks(pa.array([texts[d] or "" for d in ids], pa.string())):
        key |= dict(zip(ids[i:j], packing.curve_keys(raw, off).tolist(), strict=True))
    first = packing.pack(docs, BYTES).where("start = 0").select("doc_id", "sequence_id", "offset").toPandas().sort_values(["sequence_id", "offset"])
    own = np.array([key[d] for d in first.doc_id])
    assert len(own) == len(ids) and (first.sequence_id.to_numpy() >> 36).max() > 3
    assert (np.diff(own) >= 0).all()


def test_many_ranges_and_groups_a_task(docs, monkeypatch):  # noqa: F811
    """Fewer partitions than ranges, groups and buckets give the same rows."""
    monkeypatch.setattr(packing, "RANGE_BYTES", 100_000)
    monkeypatch.setattr(lm_score, "GROUP_BYTES", 200_000)
    scored = lambda: {i: (r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for i, r in by_id(lm_score.score_documents(docs)).items()}
    packed = lambda: packing.digest(packing.pack(docs, BYTES))
    want = scored(), sorted(map(tuple, packed().collect()))
    monkeypatch.setattr(common, "PARTITIONS", 3)
    few = packed()
    assert few.rdd.getNumPartitions() == 3
    assert (scored(), sorted(map(tuple, few.collect()))) == want


@pytest.mark.parametrize("which", ["empty", "odd"])
def test_pipeline_on_awkward_tables(request, spark, tmp_path, which):
    """The whole run, and its stages, on no documents, and on nulls, ties, long texts and clashing names."""
    table = request.getfixturevalue(which)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    bench = common.table(spark, DATA, "benchmark")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = common.table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = common.cut(stage(spark, stages, str(tmp_path)))
        assert stages.columns == common.DOCUMENT_COLUMNS
    left = {r["doc_id"] for r in stages.collect()}
    # by hand: of what quality keeps, later repeats go, then near copies, then benchmark passages
    good = {r["doc_id"]: r["text"] for r in quality.keep_good(table).collect()}
    single = brute.repeated_lines(good)
    first = {i: single[i] for i, (_, least) in brute.components(single).items() if i == least}
    clean = {i for i, x in brute.passages(first, {r["item_id"]: r["text"] for r in bench.collect()}).items() if not x[-1]}
    assert left == clean and (which == "empty") == (not left)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == clean
    assert (out.agg(F.sum("length")).first()[0] or 0) == (out.where("start = 0").agg(F.sum("doc_tokens")).first()[0] or 0)

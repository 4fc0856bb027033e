"""What must not grow with the input: passes over the texts, cost by group, tables sent whole to every task."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from scopeledger.llm import common, components, filters, mixing, phrases, quality, simhash, similar
from scopeledger.llm.common import stage


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=200)) + ". the end of the day" for _ in range(60)]
    rows = [(i, t, ("en", None, "de", "fr")[i % 4]) for i, t in enumerate(texts)]
    return stage(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(4), "growth-prose")


@pytest.mark.parametrize("budget", [1, 2, 9, 100, 1 << 20])
def test_heavy_prefixes_cost_no_further_pass(prose, monkeypatch, budget):
    """However many words heavy prefixes have, texts are dealt twice and the counts are those of a plain count."""
    names = []
    monkeypatch.setattr(phrases, "stage", lambda df, name: names.append(name) or stage(df, name))
    counts, sizes = phrases.phrase_counts(prose, least=3, budget=budget)
    assert sorted(n for n in names if n.startswith("phrases-")) == ["phrases-2", "phrases-5"]
    plain, n = {}, {}
    for row in prose.collect():
        lang = row.lang or "und"
        for piece in row.text.split("."):
            words = piece.split()
            n[lang] = n.get(lang, 0) + len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    key = lang, " ".join(words[i:i + k])
                    plain[key] = plain.get(key, 0) + 1
    got = [((r.lang, bytes(r.phrase).decode()), r.f) for r in counts.collect()]
    assert len(got) == len(dict(got)) and dict(got) == {k: f for k, f in plain.items() if f >= 3}
    assert {r.lang: r.n for r in sizes.collect()} == n


def test_cost_of_dealing_does_not_follow_the_groups():
    """A chunk meets more groups the larger the input is; each must not cost a pass of its own."""
    rng = np.random.default_rng(1)
    names = np.array([f"word{i}" for i in range(3000)])
    text = " ".join(names[rng.integers(0, 3000, 120_000)]).encode()
    every = b"\xff" * (filters.BITS // 8)
    none = bytes(filters.BITS // 8)

    def seconds(groups: int) -> float:
        took = []
        for _ in range(3):
            batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text], pa.binary())], ["lang", "text"])
            began = time.process_time()
            rows = sum(b.num_rows for b in phrases._deal(every, none, None, None, groups)([batch]))
            took.append(time.process_time() - began)
        assert rows > 0.9 * min(groups, 3000)
        return min(took)

    assert seconds(1 << 20) < 2.5 * seconds(8)


def test_wide_and_narrow_messages_meet_in_a_group():
    """A message of more than 65,535 different words has wider numbers."""
    found = [phrases.BREAK, *(f"w{i}".encode() for i in range(70_001))]
    digests = filters.digests(found)
    wide = np.column_stack((np.arange(1, 70_001), np.arange(2, 70_002)))
    narrow = np.array([[1, 2], [3, 1]])
    ones = lambda t: np.ones(len(t), np.int64)
    parts = [phrases.messages(lang, found, digests, 1, t, 5 * ones(t), ones(t)) for lang, t in (("a", wide), ("a", narrow), ("b", narrow))]
    out = phrases._subtree(6, 2, 2)(pa.Table.from_batches(parts))
    assert out.to_pylist() == [{"lang": "a", "phrase": b"w0 w1", "f": 10}]


def _texts(n: int) -> list[str]:
    rng = random.Random(8)
    words = [f"x{i}" for i in range(400)]
    made = [" ".join(rng.choices(words, k=60)) for _ in range(n)]
    near = [t + " end" for t in made[::3]] + [t.replace("x1 ", "y ") for t in made[1::3]] + made[::5]
    return made + near


def _plans_of(monkeypatch, *modules) -> list[str]:
    """Plans of all tables that the modules stage from here on, as they are first made."""
    plans = []

    def staged(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    for module in modules:
        monkeypatch.setattr(module, "stage", staged)
    return plans


def test_near_dedup_broadcasts_no_side_that_grows(spark, monkeypatch):
    """However small Spark takes a side to be, as after an explode: blocks of fingerprints, bands, cells and nodes are merged."""
    texts = _texts(60)
    docs = stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(3), "growth-docs")
    for module in (components, simhash, similar):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0, raising=False)
    plans = _plans_of(monkeypatch, components, simhash, similar)
    kept = similar.drop_similar(docs, known=simhash.near_rows(docs))
    groups = simhash.near_groups(docs)
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (kept, groups)]
    assert sum("SortMergeJoin" in p for p in plans) >= 8
    assert not any("BroadcastHashJoin" in p or "ShuffledHashJoin" in p for p in plans)
    assert kept.count() == 60 and groups.where("kept").count() <= len(texts) - 12


def test_mixing_and_labels_broadcast_no_side_that_grows(spark, monkeypatch):
    """Rows drawn, added and taken back, and the labels, are merged; only counted tables, by source or language, are broadcast."""
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(20, 60)) + f" {i}", "abc"[i % 7 % 3], "en") for i in range(400)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(3), "growth-docs")
    labels = stage(spark.createDataFrame([(i, i % 2) for i in range(0, 400, 2)], "doc_id long, quality int"), "growth-labels")
    plans = _plans_of(monkeypatch, mixing, quality)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(mixing, "SMALL", 20)
    plan = mixing.mix_plan(docs, (5, 2, 1), 3.0)
    plans.append(plan._jdf.queryExecution().executedPlan().toString())
    quality.keep_good(docs, labels).count()
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert joins and not [line for line in joins if "_row" in line or "_label_id" in line]
    taken = {r.source_size: r.taken for r in plan.groupBy("source_size").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "taken").collect()}
    target = {r.source_size: r.target for r in plan.select("source_size", "target").distinct().collect()}
    assert all(abs(taken[s] - t) < 0.01 * t for s, t in target.items())

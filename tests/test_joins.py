"""Joins of tables that Spark takes to be smaller than they are: none is broadcast by an estimate."""

import random

import numpy as np

from fieldglass import work
from fieldglass.llm import graph, near_dup


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plans_of(monkeypatch, module):
    """Plans of the work tables that a module writes."""
    found = []
    written = module.written
    monkeypatch.setattr(module, "written", lambda df: (found.append(plan(df)), written(df))[1])
    return found


def test_rows_decide(spark):
    few, many = work.by_rows(spark.range(9)), work.by_rows(spark.range(9), work.FEW_ROWS + 1)
    assert "BroadcastHashJoin" in plan(spark.range(20).join(few, "id"))
    for how in ("inner", "left", "left_anti"):
        assert "SortMergeJoin" in plan(spark.range(20).join(many, "id", how))


def test_near_duplicates_by_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sigs = rng.integers(0, 40, size=(1500, near_dup.COORDS)).tolist()
    reps = work.written(spark.createDataFrame(list(enumerate(sigs)), "rep long, sig array<int>"))
    assert "Broadcast" not in plan(near_dup._shared_lists(reps))  # 36,000 pairs of coordinate and value at most

    monkeypatch.setattr(work, "FEW_ROWS", 100)
    random.seed(4)
    words = [[random.choice("abcdefghij") * 3 + str(random.randrange(500)) for _ in range(30)] for _ in range(300)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:28], "x", "y"]) for w in words]
    found = plans_of(monkeypatch, near_dup), plans_of(monkeypatch, graph)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i % 300 for i in range(600)}
    asked = [p for p in found[0] if "MapInArrow" in p and "side" in p]  # rows that ask for sets are counted and broadcast up to FEW
    assert not any("BroadcastHashJoin" in p for p in found[0] if p not in asked) and not any("BroadcastHashJoin" in p for p in found[1])


def test_exact_copies_by_rows(spark, monkeypatch):
    from fieldglass.llm import common, exact_dedup

    docs = spark.createDataFrame([(i, f"text {i % 500}") for i in range(1000)], "doc_id long, text string")
    monkeypatch.setattr(work, "FEW_ROWS", 100)
    found = exact_dedup.kept_documents(docs)
    assert "SortMergeJoin" in plan(found) and "BroadcastHashJoin" not in plan(found)
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(500))
    told = plan(exact_dedup.exact_dedup(docs))
    assert "SortMergeJoin" in told  # winners; only hot digests, bounded, are broadcast
    assert common.by_rows is work.by_rows


def test_titles_without_broadcasts(spark, monkeypatch):
    """Pixels, taps and glyphs are exploded or compress well: no side of a join is broadcast because it seems small."""
    from fieldglass.operators import sweep

    rows = [(k, x, y, 200 if x % 3 and 1 < y < 8 - k % 3 else 10 * y) for k in range(6) for x in range(10) for y in range(9)]
    pixels = spark.createDataFrame(rows, "key long, x int, y int, gray int")
    found = plans_of(monkeypatch, sweep)
    got = sweep.title_sweep(pixels, pixels.select("key").distinct().selectExpr("key", "9 AS rows", "10 AS cols"))
    assert {r["key"] for r in got.collect()} == set(range(6))
    assert not any("Broadcast" in p for p in [*found, plan(got)]) and any("SortMergeJoin" in p for p in found)

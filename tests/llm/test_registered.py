"""The registered queries and the pipeline on the smallest tables."""

from pathlib import Path

import pytest

from fieldglass.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    other = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(repr(r[i]) for i in order) for r in df.collect()) == sorted(tuple(repr(r[i]) for i in other) for r in found.fetchall())


def test_pipeline_stages(spark):
    """Each stage against brute force on what it was given."""
    import re

    import corpus_pipeline
    from fieldglass.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = written(stage(spark, docs, SF))
        after = {r["doc_id"]: r for r in docs.collect()}
        kept[name] = set(after)
        assert set(after) <= set(before) and docs.count() == len(after)
        if name != "sentencepiece":
            told = {"lang"} if name == "language_id" else set()  # the language found takes the label's place
            assert docs.columns == columns and all(after[i][c] == before[i][c] for i in after for c in columns if c not in told)
        if name == "language_id":
            gone = [before[i] for i in before if i not in after]
            assert all(not any(map(str.isalpha, r["text"] or "")) or len(r["text"]) < 40 for r in gone)
        if name == "exact_dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            first = {}
            for i in sorted(before):
                first.setdefault(norm(before[i]["text"]), i)
            assert set(first.values()) == set(after)
        if name == "near_dedup":
            from tests.llm.test_documents import brute_components

            ids = sorted(before)
            found = brute_components([before[i]["text"] for i in ids])
            assert {ids[c] for _, c in found} == set(after)
        if name == "sentencepiece":
            assert set(after) == set(before)
    assert len(kept["mixing"]) > 0.3 * len(kept["near_dedup"])


def test_stages_with_nulls_repeats_and_clashing_names(spark):
    """Rows that repeat, null ids and texts, and columns named like the operators' own."""
    import corpus_pipeline

    names = "_p _found _source _lang _topic _kept_id doc id text2 digest copies keep of component_id kept probability found rep".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    tail = (1, *["x"] * len(names))
    prose = "the cat sat on the mat and the dog lay near it all day long"
    rows = [(1, "a b", "en", "s", *tail)] * 2 + [(5, "a b", "en", "s", *tail), (5, "zzz q", "en", "s", *tail), (None, prose, "en", None, *tail)]
    rows += [(7, prose + " today", None, "s", *tail), (8, prose + " today now", "en", "s", *tail), (8, prose + " today now", "en", "s", *tail), (9, None, "en", "s", *tail), (10, "", None, None, *tail), (11, "12", "en", "s", *tail)]
    rows += [(12, "w " * 30_000, "en", "s", *tail)]
    docs = spark.createDataFrame(rows, schema)
    found = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        found[name] = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert sorted(found["exact_dedup"], key=str) == sorted({(1, "a b"), (5, "zzz q"), (None, prose), (7, prose + " today"), (8, prose + " today now"), (9, None), (11, "12"), (12, "w " * 30_000)}, key=str)
    near = found["near_dedup"]
    assert [x for x in near if x[0] in (7, 8)] == [(7, prose + " today")] and (None, prose) in near and (9, None) in near and len([x for x in near if x[0] == 1]) == 1
    assert {x[0] for x in found["language_id"]} == {1, 5, None, 7, 8, 12}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)

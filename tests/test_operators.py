"""Operators on rows worked out by hand."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.functions import geometry as g
from fieldglass.functions import text as t
from fieldglass.operators import boxes, curate, evaluate, lines, matching, resolve, vectors
from fieldglass.sources import readers, writers

CATALOG = {
    "_note": {"n": "ignored", "c": []},
    "b1": {"n": "Bee", "c": [["s", 4], ["d", 12]]},
    "b2": {"n": "Étoile Filante", "c": [["s", 7], ["s", 18], ["d", None], ["hd", 15]]},
    "b3": {"n": "Point Break", "c": [["s", 21], ["", 9]]},
    "b4": {"n": "Etoile  filante", "c": [["s", 1]]},
}


@pytest.fixture(scope="module")
def catalog(spark):
    return readers.parse_catalog(spark.createDataFrame([(json.dumps(CATALOG),)], "value string"))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_catalog_keeps_order(catalog):
    got = catalog.orderBy("ord").collect()
    assert [r["key"] for r in got] == ["b1", "b2", "b3", "b4"]
    assert [(c["type"], c["level"]) for c in got[1]["charts"]] == [("s", 7), ("s", 18), ("hd", 15)]


def test_text(spark):
    r = one(spark, t.normalize_match(F.lit("  Éa--B  c! ")).alias("m"), t.normalize_key(F.lit("Éa--B  ñ c!")).alias("k"), F.size(t.trigrams(F.lit("aaaaaa"))).alias("n"),
            F.size(t.trigrams(F.lit(""))).alias("e"), t.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("j"), t.round_half_even(F.lit(2.5)).alias("r"),
            t.significant(F.lit(0.123456789)).alias("s"), t.clean_name(F.lit(' "a ""b"" c" ')).alias("c"), t.chart_key(F.lit("halfdouble")).alias("h"), t.digit_of(F.lit(55)).alias("d"))
    assert (r["m"], r["k"], r["n"], r["e"], r["j"], r["r"], r["s"], r["c"], r["h"], r["d"]) == ("ea b c", "ea--b n c!", 5, 1, 0.5, 2.0, 0.123457, 'a "b" c', "hd", 7)
    s = spark.createDataFrame([("abcXdef", "defXabc"), ("", "")], "a string, b string").select(t.block_similarity(F.col("a"), F.col("b")).alias("s")).select("s.*").collect()
    assert [round(x["ratio"], 4) for x in s] == [round(6 / 14, 4), 1.0] and s[0]["common"] == 3
    scores = {"0971041": 971041, "1000000": 1000000, "12345678": None, "": None, "42": 42}
    got = spark.createDataFrame([(k,) for k in scores], "d string").select("d", t.score_value(F.col("d")).alias("v")).collect()
    assert {x["d"]: x["v"] for x in got} == scores


def test_geometry(spark):
    b = g.box(F.lit(10), F.lit(20), F.lit(30), F.lit(60))
    r = one(spark, g.turn_back(b, F.lit(1), F.lit(100), F.lit(200)).alias("a"), g.turn_back(b, F.lit(2), F.lit(100), F.lit(200)).alias("c"), g.crop(b, F.lit(31), F.lit(100), 0.1).alias("p"),
            g.iou(b, g.box(F.lit(10), F.lit(20), F.lit(30), F.lit(40))).alias("i"), g.map_back(g.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), F.array(*[F.lit(x) for x in (2.5, 0.0, -2.5, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])).alias("m"))
    assert tuple(r["a"]) == (20, 170, 60, 190) and tuple(r["c"]) == (40, 10, 80, 30)
    assert tuple(r["p"]) == (8, 16, 31, 64) and r["i"] == 0.5 and tuple(r["m"]) == (-3, 0, 0, 1)


def det(spark, rows):
    df = spark.createDataFrame(rows, "key string, cls int, x1 int, y1 int, x2 int, y2 int, conf double, ord int")
    return df.select("key", "cls", g.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("box"), "conf", "ord")


def test_nms(spark):
    d = det(spark, [("p", 0, 0, 0, 10, 10, 0.9, 1), ("p", 0, 1, 1, 11, 11, 0.8, 2), ("p", 0, 20, 20, 30, 30, 0.7, 3), ("p", 1, 0, 0, 10, 10, 0.1, 4), ("q", 0, 0, 0, 4, 4, 0.5, 5), ("q", 0, 0, 0, 4, 4, 0.5, 6)])
    kept = boxes.nms(d)
    assert sorted((r["key"], r["ord"]) for r in kept.collect()) == [("p", 1), ("p", 3), ("p", 4), ("q", 5)]
    again = boxes.nms(kept)
    assert sorted(r["ord"] for r in again.collect()) == sorted(r["ord"] for r in kept.collect())
    assert boxes.nms(d.limit(0)).count() == 0
    assert boxes.best_turn(d.withColumn("turn", F.col("cls"))).orderBy("key").first()["turn"] == 1


def test_match_and_levels(spark, catalog):
    reads = spark.createDataFrame([("a", "etoile filant"), ("b", "!!!"), ("c", "pointbreak")], "key string, text string")
    got = {(r["key"], r["rank"]): r["name"] for r in matching.match(reads, catalog, 2).collect()}
    assert got[("a", 1)] == "Étoile Filante" and got[("a", 2)] == "Etoile  filante" and got[("c", 1)] == "Point Break" and ("b", 1) not in got
    # places that overlap leaves free are filled in the catalog's order
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["xyz", "uvw", "abcd", "rst", "abc"])], "ord int, name string")
    found = matching.trigram_candidates(spark.createDataFrame([("k", "abc")], "key string, text string"), names, limit=4)
    assert [(r["ord"], r["jac"] > 0) for r in found.orderBy(F.desc("jac"), "ord").collect()] == [(4, True), (2, True), (0, False), (1, False)]
    charts = {r["key"]: r["charts"] for r in matching.charts_for(spark.createDataFrame([(1, "B3"), (2, "bee!"), (3, "nobody"), (4, None)], "key int, name string"), catalog).collect()}
    assert [c["level"] for c in charts[1]] == [21, 9] and [c["level"] for c in charts[2]] == [4, 12] and charts[3] == charts[4] == []
    songs = spark.createDataFrame([(1, "Étoile filante", "s"), (2, "Bee", "c"), (3, "Point Break", "s"), (4, "none", None), (5, "Bee", None)], "key int, name string, chart string")
    assert {r["key"]: r["levels"] for r in matching.levels_for(songs, catalog).collect()} == {1: [7, 18], 2: [4, 12], 3: [9, 21], 4: None, 5: [4, 12]}


READINGS = {
    "empty": None,
    "clear": {"titles": [{"raw": "etoile filante", "raw2": "etoile filante", "conf": 0.9, "box": [1, 2, 3, 4]}], "chart_type": "single", "chart_conf": 0.9, "score": 971041, "score_margin": 0.2,
              "level_digits": [1, 8], "level_scores": [[0.1, 0.9] + [-1.0] * 8, [-1.0] * 7 + [0.95, 0.9, -1.0]]},
    "agreed": {"titles": [{"raw": "zzzz"}], "chart_type": "single", "chart_conf": 0.10, "score": 5, "score_margin": 0.0099, "score2": 5, "level_digits": [8, 1], "level_scores": [[0.0] * 10, [0.0] * 10]},
    "apart": {"titles": [{"raw": ""}], "score": 5, "score_margin": 0.0099, "score2": 6, "level_digits": [2, -1], "level_scores": [[0.0] * 10]},
    "lone": {"titles": [], "score": 5, "score_margin": 0.0099, "level_digits": [-1, 2], "level_scores": [[0.0] * 10]},
    "six": {"titles": [{"raw": ""}, {"raw": "bee"}, {"raw": "bee"}, {"raw": ""}, {"raw": ""}, {"raw": "point break"}], "level_digits": [4], "level_scores": [[0.0, 0, 0, 0, 0.5, 0, 0, 0, 0, 0], [0.0] * 10]},
}


def test_readings(spark, catalog):
    rows = spark.createDataFrame([(k, None if v is None else json.dumps(v)) for k, v in READINGS.items()], "key string, native string")
    got = {r["key"]: r for r in resolve.readings(readers.read_native(rows), catalog).collect()}
    field = lambda k, f: (got[k][f]["value"], got[k][f]["reason"])
    assert field("empty", "song") == (None, "margen_bajo") and got["empty"]["song"]["confidence"] == 1.0
    assert field("empty", "chart_type") == (None, "baja_confianza") and field("empty", "score") == (None, "sin_glifos") and field("empty", "level") == (None, "sin_glifos")
    assert got["empty"]["needs_llm"] == ["song", "level", "chart_type", "score"] and got["empty"]["needs_vlm_call"]
    assert field("clear", "chart_type") == ("single", None) and field("clear", "score") == (971041, None)
    assert got["clear"]["candidates"][0]["name"] == "Étoile Filante" and got["clear"]["raw"] == "etoile filante"
    assert field("agreed", "score") == (5, None) and field("agreed", "song")[1] in ("sin_parecido", "margen_bajo") and field("agreed", "level") == (None, "fuera_de_rango")
    assert field("apart", "score") == (None, "margen_bajo") and field("apart", "level") == (None, "no_numerico")
    assert field("lone", "score") == (None, "margen_bajo") and field("lone", "level") == (None, "fuera_de_rango")
    assert field("six", "song") == ("Bee", None) and got["six"]["raw"] == "bee | bee"
    for r in got.values():
        for f in ("song", "level", "chart_type", "score"):
            assert (r[f]["reason"] is None) == (r[f]["value"] is not None)


def test_level_choice(spark):
    tie = [[0.5] * 10, [0.5] * 10]
    r = one(spark, resolve.level_choice(F.array(F.lit(12), F.lit(4)), F.from_json(F.lit(json.dumps(tie)), "array<array<double>>")).alias("c"))
    assert (r["c"]["level"], r["c"]["margin"]) == (4, 0.0)


def test_vectors(spark):
    bank = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [0.8, 0.6]), (2, 3, [0.0, 1.0])], "idx int, label int, vec array<double>")
    rows = spark.createDataFrame([(7, [1.0, 0.1])], "id int, vec array<double>")
    c = vectors.classify(rows, bank).first()
    assert (c["label"], round(c["sim"], 6), round(c["margin"], 6)) == (1, 1.0, 0.9)
    assert [round(x, 6) for x in vectors.digit_scores(rows, bank).first()["scores"]] == [-1, 1.0, -1, 0.1, -1, -1, -1, -1, -1, -1]
    k = vectors.knn_vote(rows, bank, k=3).first()
    assert (k["label"], round(k["conf"], 4)) == (1, 0.6667)
    assert vectors.knn_vote(rows, bank, k=3, least=0.7).count() == 0


def test_matching_by_index_and_by_join(spark, monkeypatch):
    """A catalog that tasks hold and one that is joined give the same rows; so does scoring every pair."""
    import random

    from fieldglass.functions.text import blocks

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    names = [f"{word()} {word()}" for _ in range(200)]
    texts = [word() + rng.choice(names)[1:] for _ in range(40)] + ["", "zzz", "!", names[0]]
    catalog = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, name string")
    reads = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    both = []
    for most in (20_000, 3):
        monkeypatch.setattr(matching, "INDEXED", most)
        both.append((rows(matching.match(reads, catalog, 3, 20)), rows(matching.trigram_candidates(reads, catalog, 20).drop("read"))))
    assert both[0] == both[1] and len(both[0][1]) == 42 * 20  # two reads have no letter
    grams = lambda t: {("  " + t + "  ")[i : i + 3] for i in range(len(t) + 2)}
    for key, text in enumerate(texts):
        a = "".join(c for c in text.lower() if c.isalnum())
        if not a:
            continue
        near = sorted((-len(grams(a) & grams(b)) / len(grams(a) | grams(b)), i) for i, b in enumerate(n.replace(" ", "") for n in names))[:20]
        full = []
        for jac, i in near:
            b = names[i].replace(" ", "")
            ratio, common = blocks(a, b)
            full.append((-round((0.45 * -jac + 0.35 * ratio + 0.2 * (common / max(min(len(a), len(b)), 1))) * 1e4) / 1e4, jac, i))
        assert [r[1:3] + r[4:] for r in both[0][0] if r[0] == key] == [(rank, i, -s) for rank, (s, _, i) in enumerate(sorted(full)[:3], 1)]


def test_sequences(spark):
    c = spark.createDataFrame([("a", i, x, 0, 5, 10) for i, x in enumerate((0, 6, 12, 60, 66))], "key string, ord int, x int, y int, w int, h int")
    assert sorted(r["ord"] for r in lines.dominant_line(c).collect()) == [0, 1, 2]
    m = spark.createDataFrame([("a", 0, 0, 9, 10, 4), ("a", 1, 4, 2, 10, 3), ("a", 2, 30, 0, 5, 1)], "key string, ord int, x int, y int, w int, h int")
    assert [tuple(r)[1:] for r in lines.merge_by_x(m).orderBy("part").collect()] == [(0, 0, 2, 14, 11), (1, 30, 0, 5, 1)]
    # single precision: an overlap of 55 of 100 joins, and so at each of these widths
    pair = lambda w, over: [(str(w), 0, 0, 0, w, 5), (str(w), 1, w - over, 0, w, 5)]
    bound = spark.createDataFrame([r for w in (100, 180, 200, 220, 340) for r in pair(w, w * 55 // 100)], m.schema)
    assert lines.merge_by_x(bound).count() == 5 and lines.merge_by_x(spark.createDataFrame(pair(100, 54), m.schema)).count() == 2


def test_dominant_line_edges(spark):
    kind = "key string, ord int, x int, y int, w int, h int"
    kept = lambda rows: sorted(r["ord"] for r in lines.dominant_line(spark.createDataFrame([("a", i, *r) for i, r in enumerate(rows)], kind)).collect())
    assert kept([(0, 0, 5, 10)]) == [0] and kept([(0, 0, 5, 10), (900, 0, 5, 10)]) == [0, 1]  # fewer than three stay, however far apart
    assert kept([(0, 0, 5, 10), (6, 0, 5, 100), (900, 0, 9, 1000)]) == [0, 1, 2]  # one near the median height: nothing is filtered or cut
    assert kept([(0, 0, 5, 10), (6, 0, 5, 10), (12, 0, 5, 10), (18, 0, 5, 99), (60, 0, 9, 10)]) == [0, 1, 2]  # the median of all heights, 10, bounds the gaps
    # gaps 45, 45, 45 and 117: single precision puts 2.6 * 45 below 117, so that begins a new run
    row, x = [], 0
    for gap in (45, 45, 45, 117):
        row.append((x, 0, 10, 10))
        x += 10 + gap
    assert kept([*row, (x, 0, 10, 10)]) == [0, 1, 2, 3] and kept([*row, (x - 1, 0, 10, 10)]) == [0, 1, 2, 3, 4]
    near = spark.createDataFrame([("a", i, i * 20, 0, 5, h) for i, h in enumerate((150, 150, 150, 213, 87))], kind)
    assert lines.height_filter(near).count() == 3  # 63 is more than 0.42 of 150 in single precision


def test_runs(spark):
    run = spark.createDataFrame([("a", y, v) for y, v in enumerate([0, 1, 1, 0, 1, 1, 0])], "key string, y int, v int")
    assert tuple(lines.longest_run(run, F.col("v") == 1).first()) == ("a", 1, 2)


def test_component_filters(spark):
    kind = "key string, ord int, x int, y int, w int, h int, area int, bright double, rows int, cols int"
    row = lambda o, y, w, h, area=100, bright=200.0: ("a", o, o * 20, y, w, h, area, bright, 100, 60)
    kept = lambda df: sorted(r["ord"] for r in df.collect())
    c = spark.createDataFrame([row(0, 0, 10, 20), row(1, 0, 10, 11, 1), row(2, 0, 31, 20), row(3, 0, 10, 12, 2), row(4, 0, 10, 20, 100, 100.0), row(5, 0, 10, 20, 9)], kind)
    assert kept(lines.title_components(c)) == [0, 3, 4, 5]  # 1 is low and small, 2 over half the width
    assert kept(lines.badge_components(c.withColumn("rows", F.lit(10)).withColumn("cols", F.lit(50)))) == [0, 2, 4]  # below 10 pixels the rest
    assert kept(lines.score_components(c)) == [0, 2]  # 1 hasn't the pixels, 3 is neither, 4 is dark, 5 unfilled
    # the line's tolerance comes from the band of high glyphs alone
    heights = spark.createDataFrame([row(0, 0, 10, 100), row(1, 30, 10, 100), *[row(o, 200, 4, 10) for o in range(2, 6)]], kind)
    assert kept(lines.same_line(heights)) == [0, 1]
    # gaps are those of ordered centres: the second lies within the first
    nested = spark.createDataFrame([("a", 0, 0, 0, 100, 10), ("a", 1, 10, 0, 10, 10), ("a", 2, 90, 0, 10, 10), ("a", 3, 120, 0, 10, 10)], "key string, ord int, x int, y int, w int, h int")
    gaps = np.diff(sorted([50.0, 15.0, 95.0, 125.0]))
    r = lines.plausibility(nested).first()
    assert r["tier"] == 1 and abs(r["regularity"] + gaps.std() / gaps.mean()) < 1e-9


def test_ranks_cut_stretches_until_they_are_short(spark, monkeypatch):
    import random

    rng = random.Random(6)
    rows = [(k, rng.randint(0, 4000) / 8) for k in ("a", "b") for _ in range(900)] + [("a", 7.0)] * 300 + [("c", 1.0), ("c", None)]
    frame = spark.createDataFrame(rows, "key string, value double")
    monkeypatch.setattr(lines, "STEPS", 8)
    monkeypatch.setattr(lines, "STRETCH", 12)
    got = {r["key"]: r for r in lines.percentiles(frame, "key", "value", 0.9).collect()}
    for k in ("a", "b", "c"):
        v = sorted(x for y, x in rows if y == k and x is not None)
        at = 0.9 * (len(v) - 1)
        assert got[k]["lower"] == v[int(at)] and got[k]["upper_median"] == v[len(v) // 2] and got[k]["median"] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
        assert abs(got[k]["linear"] - (v[int(at)] + (at - int(at)) * (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]))) < 1e-9


def test_ranks(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.integers(0, 50, 5000).astype(float), "b": rng.normal(size=3000), "c": np.array([7.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("d", None)], "key string, value double")
    got = {r["key"]: r for r in lines.percentiles(rows, "key", "value", 0.9).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        v = np.sort(v)
        r = got[k]
        assert r["lower"] == v[int(0.9 * (len(v) - 1))] and abs(r["linear"] - np.percentile(v, 90)) < 1e-12
        assert r["upper_median"] == v[len(v) // 2] and abs(r["median"] - np.median(v)) < 1e-12
    assert lines.percentiles(rows.limit(0), "key", "value", 0.5).count() == 0


def test_metrics(spark):
    a = spark.createDataFrame([("s", 1, 1), ("s", 2, 1), ("s", None, 1), ("s", 3, None)], "field string, value int, truth int").withColumn("ok", F.col("value") == F.col("truth"))
    r = evaluate.field_metrics(a, ["field"]).first()
    assert (r["n"], round(r["coverage"], 4), r["precision"], round(r["accuracy"], 4)) == (3, 0.6667, 0.5, 0.3333)
    assert abs(r["coverage"] * r["precision"] - r["accuracy"]) < 1e-12
    assert evaluate.field_metrics(a.where("false"), ["field"]).count() == 0


def test_upsert(spark):
    known = spark.createDataFrame([("bee",)], "key string")
    kind = "ord int, name string, charts array<struct<type:string,level:int>>"
    batch = spark.createDataFrame([(0, "New", []), (1, '"New"', [("s", 1)]), (2, "NEW", [("s", 2)]), (3, "Bee", [("s", 3)]), (4, None, [("s", 3)])], kind)
    assert [(r["ord"], r["name"]) for r in curate.catalog_upsert(known, batch).collect()] == [(1, "New")]


def test_readers(spark, tmp_path):
    tsv = tmp_path / "gt.tsv"
    tsv.write_text("# image\tsong\n\na/b/x1.jpg\tSong\t123\ts\t18\t1\ny.png\tOther\tbad\thd\t?\t0\nshort\tline\n")
    got = {r["key"]: tuple(r)[1:] for r in readers.read_truth_tsv(spark, str(tsv)).collect()}
    assert got == {"x1": ("Song", 123, "single", 18), "y": ("Other", None, None, None)}
    bank = tmp_path / "bank.bin"
    x = np.zeros((2, 768), np.int8)
    x[0, :2], x[1, 5] = (30, 40), 100
    bank.write_bytes(b"PIUT" + struct.pack("<iiif", 2, 768, 1, 1.0) + np.array([3, 9], "<i4").tobytes() + x.tobytes())
    got = readers.read_bank(spark, str(bank)).orderBy("idx").collect()
    assert [r["label"] for r in got] == [3, 9] and np.allclose(got[0]["vec"][:2], [0.6, 0.8])
    bank.write_bytes(bank.read_bytes()[:-1])
    assert readers.read_bank(spark, str(bank)).count() == 0
    param = tmp_path / "net.param"
    param.write_text("7767517\nReshape r 1 1 a b 0=21504 1=144\nReshape r 1 1 a b 0=77\n")
    assert readers.detector_size(spark, str(param)) == 1024
    r = one(spark, writers.reading_json(readers.reading_of(F.lit('{"score": 5}'))).alias("j"), readers.shrink_power(F.lit(9000), F.lit(10)).alias("p"))
    assert json.loads(r["j"])["score"] == 5 and r["p"] == 4


def test_pixels(spark):
    from fieldglass.operators import pixels

    picture = ["XX..X", "X...X", "..X..", "XX..X"]
    mask = spark.createDataFrame([("a", x, y) for y, row in enumerate(picture) for x, c in enumerate(row) if c == "X"], "key string, x int, y int")
    got = sorted((r["x"], r["y"], r["w"], r["h"], r["area"]) for r in pixels.components(mask).collect())
    assert got == [(0, 0, 2, 2, 3), (0, 2, 3, 2, 3), (4, 0, 1, 2, 2), (4, 3, 1, 1, 1)]
    assert pixels.components(mask.limit(0)).count() == 0
    rows = spark.createDataFrame([("a", x, y, 200 if 8 <= y < 16 else 20) for y in range(24) for x in range(3)], "key string, x int, y int, gray int")
    assert tuple(pixels.focus_band(rows).first()) == ("a", 6, 18)
    h = one(spark, pixels.hsv(F.lit(0), F.lit(0), F.lit(255)).alias("r"), pixels.hsv(F.lit(255), F.lit(0), F.lit(0)).alias("b"), pixels.hsv(F.lit(7), F.lit(7), F.lit(7)).alias("n"))
    assert (tuple(h["r"]), tuple(h["b"]), tuple(h["n"])) == ((0, 255, 255), (120, 255, 255), (0, 0, 7))


def test_stream(spark, catalog, tmp_path):
    from fieldglass.streaming.readings import native_stream, trusted, write_readings

    spark.createDataFrame([("a", json.dumps({"titles": [{"raw": "bee"}], "score": 7, "score_margin": 0.5}))], "key string, native string").write.json(str(tmp_path / "in"))
    write_readings(native_stream(spark, str(tmp_path / "in")), catalog, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert [r["song"]["value"] for r in trusted(got, "song").collect()] == ["Bee"]


def test_segments(spark):
    from fieldglass.operators import segments

    c = spark.createDataFrame([("a", 0, 0, 4), ("a", 1, 5, 4), ("a", 2, 10, 4), ("b", 0, 0, 3)], "key string, ord int, x int, w int")
    got = sorted((r["key"], r["part"], r["x1"], r["x2"]) for r in segments.merge_to(c, 2).collect())
    assert got == [("a", 0, 0, 9), ("a", 1, 10, 14), ("b", 0, 0, 3)]
    q = spark.createDataFrame([(1, [10.0, 5.0, 110.0, 5.0, 110.0, 55.0, 10.0, 55.0])], "key int, quad array<double>")
    h = segments.homographies(q, 100, 50).first()["h"]
    assert np.allclose(h, [1, 0, 10, 0, 1, 5, 0, 0, 1], atol=1e-9)
    flat = spark.createDataFrame([(1, [0.0] * 8), (2, [float(x) for x in (10, 5, 110, 15, 100, 60, 12, 55)])], "key int, quad array<double>")
    got = {r["key"]: r["h"] for r in segments.homographies(flat, 100, 50).collect()}
    assert got[1] is None and np.allclose(np.array(got[2]).reshape(3, 3) @ [100, 50, 1] / (np.array(got[2])[6:] @ [100, 50, 1]), [100, 60, 1])
    c = spark.createDataFrame([("a", 0, 0, 8), ("a", 1, 20, 3)], "key string, ord int, x int, w int")
    profile = spark.createDataFrame([("a", 0, at, n) for at, n in enumerate([9, 9, 5, 1, 5, 9, 9, 9])] + [("a", 1, at, 1) for at in range(3)], "key string, ord int, at int, n int")
    split = sorted((r["part"], r["x1"], r["x2"]) for r in segments.split_to(c, profile, F.lit(3)).collect())
    assert split == [(0, 0, 3), (1, 3, 8), (2, 20, 23)]
    assert segments.split_to(c, profile, F.lit(2)).count() == 2 and segments.split_to(c, profile, F.lit(9)).count() == 5  # what is 3 wide or less is not split


def test_options():
    o = resolve.Options().changed(True, 9, 2, 0, 0)
    assert (o.rectify, o.bin_mode, o.badge_mode, o.title_variants, o.title_boxes) == (True, 0, 2, 1, 3)
    assert o.changed(False, 3, -1, 2, 5) == resolve.Options(False, 3, 2, 2, 5)


def test_truth_and_writers(spark, catalog, tmp_path):
    path = str(tmp_path / "catalog.json")
    (tmp_path / "catalog.json").write_text(json.dumps(CATALOG))
    old = readers.read_catalog(spark, path)
    added = spark.createDataFrame([(0, "n1", 'New "one"', [("s", 5)])], "ord int, key string, name string, charts array<struct<type:string,level:int>>")
    assert writers.write_catalog(old, added.limit(0), path) == 0 and writers.write_catalog(old, added, path, dry=True) == 1
    before = [tuple(r) for r in old.select("key", "name", "charts").collect()]
    assert writers.write_catalog(old, added, path) == 1
    now = readers.read_catalog(spark, path).orderBy("ord")
    assert [tuple(r) for r in now.select("key", "name", "charts").collect()] == [*before, ("n1", 'New "one"', [("s", 5)])]
    for name, value in (("song", {"_n": "x", "a": "Bee", "b": "", "c": "Point"}), ("level", {"a": ["single", 4]}), ("score", {"a": [5, 6], "c": 7})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    truth = readers.read_truth_json(spark, *[str(tmp_path / f"{n}.json") for n in ("song", "level", "score")])
    assert sorted((r["key"], r["song"], r["chart_type"], r["level"], r["scores"]) for r in truth.collect()) == [("a", "Bee", "single", 4, [5, 6]), ("c", "Point", None, None, [7])]
    (tmp_path / "boxes.json").write_text(json.dumps([{"key": "a", "file": "f", "boxes": {"title": [{"box": [1, 2, 3, 4], "conf": 0.5}, {"box": [1], "conf": 0.1}]}}]))
    assert [(r["cls"], r["ord"], r["box"] and tuple(r["box"])) for r in readers.read_boxes(spark, str(tmp_path / "boxes.json")).orderBy("ord").collect()] == [("title", 0, (1, 2, 3, 4)), ("title", 1, None)]
    native = spark.createDataFrame([("a", json.dumps({"titles": [{"raw": "bee"}], "score": 6, "score_margin": 0.5}), 12.5)], "key string, native string, ms double")
    read = resolve.readings(readers.read_native(native), catalog)
    answers = {r["field"]: (r["value"], r["ok"]) for r in evaluate.truth_answers(read, truth).collect()}
    assert answers == {"song": ("Bee", True), "level": (None, False), "chart_type": (None, False), "score": ("6", True)}
    writers.write_device_results(read, native, str(tmp_path / "device"), 3.0, "phone", "arm")
    detail = json.loads(spark.read.json(str(tmp_path / "device")).first()["json"])
    assert detail["song"] == "Bee" and detail["level"] is None and detail["native"]["score"] == 6 and detail["ms"] == 12.5
    items = spark.createDataFrame([("a", 1)], "file string, score int")
    writers.write_dataset(items, str(tmp_path / "set"))
    writers.write_dataset(items.withColumn("score", F.lit(2)), str(tmp_path / "set"), str(tmp_path / "before"))
    assert [spark.read.json(str(tmp_path / d)).first()["score"] for d in ("set", "before")] == [2, 1]
    metrics = evaluate.escalated(spark.createDataFrame([("x", 1, 1, None), ("x", None, 1, "s")], "song string, score int, level int, chart_type string"))
    assert tuple(metrics.first()) == (2, 1, 0.5)


def test_levels_are_gathered_once(spark):
    """No song carries the charts of its catalog row; nulls, empty charts and charts of no type keep their answers."""
    schema = "ord int, name string, charts array<struct<type string, level int>>"
    catalog = spark.createDataFrame([(1, "A a", [("s", 5), ("s", None), ("", 3), ("d", 7), (None, 9)]), (2, "b", []), (3, "c", None), (4, "d", [("s", 2), ("s", 1), ("s", 2)]), (5, "a-A", [("s", 1)])], schema)
    songs = spark.createDataFrame([(i, *x) for i, x in enumerate([("a a", None), ("A A", "s"), ("a a", "x"), ("a a", ""), ("b", "s"), ("c", "s"), ("d", "x"), ("d", "s"), ("e", None), (None, "s")])], "key int, name string, chart string")
    found = matching.levels_for(songs, catalog)
    got = {r["key"]: r["levels"] for r in found.collect()}
    assert got == {0: [3, 5, 7, 9, None], 1: [3, 5, None], 2: [3], 3: [3], 4: [], 5: None, 6: [1, 2], 7: [1, 2], 8: None, 9: None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "charts" not in plan[: plan.index("Join")]  # what joins songs is levels, not charts


def test_turns_of_nearly_equal_scores(spark):
    """Scores that are equal at six decimals are equal: the smaller turn stays."""
    rows = [(1, 1, 0, 0.9000001), (1, 2, 0, 0.9000004), (2, 1, 0, 0.9000001), (2, 2, 0, 0.9000011), (3, 1, 0, 0.1), (3, 1, 2, 0.7), (3, 1, 3, 0.2), (3, 2, 0, 0.2), (3, 2, 2, 0.1), (3, 2, 3, 0.7)]
    det = spark.createDataFrame(rows, "key int, turn int, cls int, conf double")
    assert {r["key"]: r["turn"] for r in boxes.best_turn(det).collect()} == {1: 1, 2: 2, 3: 1}


def test_split_asks_for_few_columns(spark, monkeypatch):
    """Many splits of many components against a plain fold; only what can be split has its columns gathered."""
    import random

    from fieldglass.operators import segments

    rng = random.Random(5)
    rows = [(k, o, rng.randrange(30), rng.randrange(1, 30)) for k in range(12) for o in range(1, 9)]
    cols = [(k, o, a, rng.randrange(5)) for k, o, x, w in rows for a in range(w)]
    c, profile = spark.createDataFrame(rows, "key int, ord int, x int, w int"), spark.createDataFrame(cols, "key int, ord int, at int, n int")
    single = lambda share, w: int(np.float32(np.float32(share) * np.float32(w)))

    def fold(key, wanted, steps=20):
        s = [(x, w, [n for k2, o2, a, n in cols if (k2, o2) == (key, o)]) for k, o, x, w in sorted(rows, key=lambda r: (r[0], r[2], r[1])) if k == key]
        for _ in range(steps):
            widths = [w for _, w, _ in s]
            if len(s) >= wanted or max(widths) < 4:
                break
            i = widths.index(max(widths))
            x, w, n = s[i]
            low, high = max(1, single(0.25, w)), min(w - 1, single(0.75, w))
            at = low + n[low:high].index(min(n[low:high])) if high > low else w // 2
            s[i : i + 1] = [(x, at, n[:at]), (x + at, w - at, n[at:])]
        return [(x, x + w) for x, w, _ in s]

    for more in (0, 1, 3, 40):
        got = {}
        for r in segments.split_to(c, profile, F.col("size") + more + F.col("key") % 2).collect():
            got.setdefault(r["key"], {})[r["part"]] = (r["x1"], r["x2"])
        assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: fold(k, 8 + more + k % 2) for k in range(12)}
    lone = segments.split_to(c.where("key = 1"), profile.where("1 = 0"), F.col("size") + 1)
    assert lone.count() == 9  # a component whose columns aren't known stays, and is split in its middle
    # of 12 x 8 components those of six keys ask for one each
    asked = segments.split_to(c, profile, F.col("size") + F.col("key") % 2)
    asked.collect()
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(_ords" in plan

"""Readers and writers on small files."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from fieldglass.sources import readers, writers


def png(rows):
    """A picture of (red, green, blue) pixels as PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "b.png").write_bytes(png([[(255, 0, 0), (0, 255, 0)]]))
    (tmp_path / "a.png").write_bytes(png([[(1, 2, 3)]]))
    (tmp_path / "c.png").write_bytes(b"no picture")
    got = [(r["origin"].rsplit("/", 1)[1], r["width"], r["height"], bytes(r["data"])) for r in readers.read_images(spark, str(tmp_path)).collect()]
    assert got == [("a.png", 1, 1, bytes([3, 2, 1])), ("b.png", 2, 1, bytes([0, 0, 255, 0, 255, 0]))]
    sizes = spark.createDataFrame([(100, 50), (4096, 1), (4097, 1), (9000, 16385)], "w int, h int")
    assert [r["p"] for r in sizes.select(readers.shrink_power(F.col("w"), F.col("h")).alias("p")).collect()] == [1, 1, 2, 4]


def test_tables_of_a_run(spark, tmp_path):
    (tmp_path / "ren.csv").write_text("old_image,new_image\na/b/old.jpg,c/new_name.png\nplain,other\n")
    assert sorted(map(tuple, readers.read_renames(spark, str(tmp_path / "ren.csv")).collect())) == [("old", "new_name"), ("plain", "other")]
    (tmp_path / "dev.json").write_text(json.dumps({"load_ms": 5.0, "device": "d", "abi": "x", "rows": {"k1_a": {"native": "{}", "ms": 7.5, "song": "Bee", "level": 4, "chart_type": None, "score": 9, "raw": "bee"}}}))
    r = readers.read_device_results(spark, str(tmp_path / "dev.json")).first()
    assert (r["key"], r["ms"], r["song"], r["level"], r["chart_type"], r["device"]) == ("k1", 7.5, "Bee", 4, None, "d")
    (tmp_path / "dump.json").write_text(json.dumps([{"song_name": "One", "charts": [{"step_type": "s", "level": 3}]}, {"song_name": "Two", "charts": []}]))
    got = [(r["ord"], r["name"], [tuple(c) for c in r["charts"]]) for r in readers.read_song_dump(spark, str(tmp_path / "dump.json")).orderBy("ord").collect()]
    assert got == [(0, "One", [("s", 3)]), (1, "Two", [])]


def test_neighbour_bank(spark, tmp_path):
    import numpy as np

    x = np.arange(60, dtype="<f4").reshape(3, 20)
    bank = tmp_path / "knn.bin"
    bank.write_bytes(b"PIUK" + struct.pack("<ii", 3, 20) + np.array([1, 0, 2], "<i4").tobytes() + x.tobytes())
    got = readers.read_bank(spark, str(bank), neighbours=True).orderBy("idx").collect()
    assert [r["label"] for r in got] == [1, 0, 2] and np.allclose([r["vec"] for r in got], x)
    bank.write_bytes(b"XXXX" + bank.read_bytes()[4:])
    assert readers.read_bank(spark, str(bank), neighbours=True).count() == 0


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", '{"score":5}', 0.123456789, "x | yz")], "key string, native string, margin double, raw string")
    envelope = rows.select(writers.envelope(F.struct("key"), F.array(F.lit(1)), F.lit(1.0), F.lit(2.0), F.lit(True)).alias("e")).first()["e"]
    assert json.loads(envelope) == {"result": {"key": "a"}, "boxes": [1], "ms": {"load": 1.0, "read": 2.0}, "detected": True}
    assert writers.six_digits(rows, ["margin"]).first()["margin"] == 0.123457
    writers.write_fixture(rows, str(tmp_path / "fixture"))
    assert spark.read.json(str(tmp_path / "fixture")).first()["native"] == '{"score":5}'
    metrics = spark.createDataFrame([("a.precision", 0.5)], "metric string, value double")
    writers.write_metrics(metrics, str(tmp_path / "metrics"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "metrics")).select("metric", "value").collect()] == [("a.precision", 0.5)]
    writers.write_glyph_sweep(rows.select("key", "margin", "raw"), str(tmp_path / "sweep"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "sweep"), sep="\t", header=True).collect()] == [("a", "0.1235", "x | yz", "3")]
    writers.write_dataset_tsv(rows.select("key", "raw"), str(tmp_path / "set"))
    assert spark.read.csv(str(tmp_path / "set"), sep="\t", header=True).first()["raw"] == "x | yz"
    empty = json.loads(spark.range(1).select(writers.reading_json(F.lit(None).cast("struct<score:int>")).alias("j")).first()["j"])
    assert empty["score"] == -1 and empty["titles"] == []

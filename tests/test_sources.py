import io
import gzip
import json

import pytest
from pyspark.sql import functions as F

from trivalent.sources import codecs, readers, sinks
from trivalent.streaming import ingest

CUBE = [[v ^ 1, v ^ 2, v ^ 4] if bin(v).count("1") % 2 == 0 else [v ^ 4, v ^ 2, v ^ 1] for v in range(8)]


def test_planar_code(spark, tmp_path):
    data = codecs.encode_planar(CUBE, header=True) + codecs.encode_planar([[1], [0]])
    (tmp_path / "a.pl").write_bytes(data)
    (tmp_path / "b.pl").write_bytes(codecs.encode_planar(CUBE))
    assert list(codecs.decode_planar(io.BytesIO(data), chunk=5)) == [CUBE, [[1], [0]]]
    spark.dataSource.register(readers.PlanarCodeSource)
    for df in (spark.read.format("planar_code").load(str(tmp_path)), readers.read_planar(spark, str(tmp_path))):
        assert sorted(len(r.rotation) for r in df.collect()) == [2, 8, 8]
    back = readers.read_planar(spark, str(tmp_path)).select(readers.planar_bytes("rotation").alias("b"), readers.planar_text("rotation").alias("t")).collect()
    assert codecs.encode_planar([[1], [0]]) in [bytes(r.b) for r in back] and "2 2 0 1 0" in [r.t for r in back]
    for bad in (b"\x00", b"\x02\x03\x00\x01\x00", b"\x02\x02\x00\x01", b""[:0] + b"\x02"):
        with pytest.raises(ValueError):
            list(codecs.decode_planar(io.BytesIO(bad)))
    with pytest.raises(ValueError):
        list(codecs.decode_planar(io.BytesIO(codecs.encode_planar(CUBE)), require_header=True))


def test_graph6(spark):
    for n in (1, 2, 5, 62, 63, 100):
        edges = [(u, v) for v in range(n) for u in range(v) if (u * 7 + v * 3) % 5 == 0]
        assert codecs.decode_graph6(codecs.encode_graph6(n, edges)) == (n, edges)
    for bad in ("", "C", "C~~", "\x01"):
        with pytest.raises(ValueError):
            codecs.decode_graph6(bad)
    df = readers.graph6_edges(spark.createDataFrame([("k4", "C~"), ("none", "B?")], "k string, t string"), "k", "t")
    assert df.where("graph = 'k4'").count() == 6 and df.where("graph = 'none'").first().u is None


def test_json_lines_and_checkpoints(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_json_lines(spark, str(tmp_path / "a.jsonl.gz"), "a int").collect()) == [1, 2]
    (tmp_path / "ok.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3')
    (tmp_path / "bad.jsonl").write_text('{"a": 1\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_checkpoint(spark, str(tmp_path / "ok.jsonl"), "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="broken line"):
        readers.read_checkpoint(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "z int, a string")
    sinks.write_json_lines(df, str(tmp_path / "out"), ["z"], gz=False)
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [{"z": 1}, {"a": "b", "z": 2}]
    assert sinks.digest(df).first() == sinks.digest(df.repartition(3)).first()
    sinks.write_csv(df, str(tmp_path / "csv"), ["a", "missing"], None)
    assert readers.read_typed_csv(spark, str(tmp_path / "csv"), "a string, missing int").where("missing is null").count() == 2
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "x.txt").write_text("x")
    (folder / "y.txt").write_text("y")
    m = sinks.manifest(spark, str(folder))
    assert {r.relative_path for r in m.collect()} == {"x.txt", "y.txt"}
    declared = m.where("relative_path = 'x.txt'").withColumn("sha256", F.lit("0")).unionByName(spark.createDataFrame([("0", "../z")], "sha256 string, relative_path string"))
    assert {tuple(r) for r in sinks.manifest_faults(declared, m).collect()} == {("x.txt", "different"), ("y.txt", "unlisted"), ("../z", "missing"), ("../z", "outside")}
    cnf = sinks.dimacs(spark.createDataFrame([([1, -2],), ([3],)], "clause array<int>"), 3, 2)
    assert {r.value for r in cnf.collect()} == {"p cnf 3 2", "1 -2 0", "3 0"}


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "id long, at timestamp"
    src, out, prog = (str(tmp_path / x) for x in ("src", "out", "prog"))
    spark.createDataFrame([(1, t(0)), (1, t(1)), (2, t(2))], schema).write.parquet(src)
    stream = lambda: ingest.stream_of(spark, src, spark.createDataFrame([], schema).schema)
    ingest.ingest_once(stream(), ["id"], "at", "1 day", out, prog)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]
    spark.createDataFrame([(2, t(3)), (3, t(4))], schema).write.mode("append").parquet(src)
    ingest.ingest_once(stream(), ["id"], "at", "1 day", out, prog)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    wout = str(tmp_path / "wout")
    ingest.windowed_counts(stream(), "at", "1 minute", "1 minute", [], wout, str(tmp_path / "wprog"))
    assert sum(r.rows for r in spark.read.parquet(wout).collect()) >= 3


def test_graph6_lines_of_a_column(spark):
    from trivalent.sources import readers

    df = spark.createDataFrame([("Bw",), ("A?",), ("D?{",)], "line string")
    got = readers.graph6_edges(df, "line", "line").groupBy("graph").agg(F.first("order").alias("order"), F.collect_list(F.when(F.col("u").isNotNull(), F.array("u", "v"))).alias("edges"))
    assert {r.graph: r.back for r in got.select("graph", readers.graph6_line("order", "edges").alias("back")).collect()} == {"Bw": "Bw", "A?": "A?", "D?{": "D?{"}

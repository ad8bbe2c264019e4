import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import files, manifest, sinks
from tessera.streaming import incremental as I


def test_loose_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "x"}\nnot json\n{"a": 2}\n')
    schema = T.StructType.fromDDL("a bigint, b string")
    assert [(r.a, r.b) for r in files.read_jsonl(spark, str(p), schema).orderBy("a").collect()] == [(1, "x"), (2, None)]
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    for text in ('[{"a": 1}, {"a": 2}]', '{"results": [{"a": 1}, {"a": 2}]}'):
        (tmp_path / "w.json").write_text(text)
        assert sorted(r.a for r in files.unwrapped_json(spark, str(tmp_path / "w.json"), T.StructType.fromDDL("a bigint")).collect()) == [1, 2]
    (tmp_path / "s.txt").write_text("x,y\n1,2\n")
    (tmp_path / "t.txt").write_text("x,z\ty\n1\t2\n")
    assert files.read_table(spark, str(tmp_path / "s.txt")).columns == ["x", "y"]
    assert files.read_table(spark, str(tmp_path / "t.txt")).columns == ["x,z", "y"]
    (tmp_path / "h.csv").write_text("exported today\nid,name\n1,a\n2,b\n")
    assert [r.name for r in files.after_header(spark, str(tmp_path / "h.csv"), "id,", T.StructType.fromDDL("id int, name string")).collect()] == ["a", "b"]
    (tmp_path / "c.txt").write_text("# head\nATP\tenergy\nTOOLONG\tx\n  # c\nZN\n")
    assert [(r.code, r.what) for r in files.commented_list(spark, str(tmp_path / "c.txt"), ("code", "what")).collect()] == [("ATP", "energy"), ("ZN", None)]
    (tmp_path / "packed").write_bytes(gzip.compress(b"hello"))
    assert files.read_maybe_gzip(str(tmp_path / "packed")) == "hello" and files.read_maybe_gzip(str(tmp_path / "c.txt")).startswith("#")
    with pytest.raises(files.NotBuilt):
        files.open_table(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError, match="the columns are"):
        files.located_columns(spark.range(1), {"x": "nope"})


def test_first_plausible_route_counts(spark, tmp_path):
    (tmp_path / "few.csv").write_text("a\n1\n")
    (tmp_path / "many.csv").write_text("a\n1\n2\n3\n")
    d = files.Dataset("d", [str(tmp_path / "gone.csv"), str(tmp_path / "few.csv"), str(tmp_path / "many.csv")], files.read_table, least=2)
    assert d.acquire(spark).count() == 3 and [a[1] for a in d.attempts] == ["AnalysisException", "only 1 rows", "ok"]


def test_files_per_key(spark, tmp_path):
    for n in ("AF-P1-F1.pdb", "AF-P1-F2.pdb", "AF-P2-F1.pdb", "readme"):
        (tmp_path / n).write_text("x")
    got = files.per_key_files(spark, str(tmp_path), r"^AF-(\w+)-").collect()
    assert {(r.key, r.path.rsplit("/", 1)[1]) for r in got} == {("P1", "AF-P1-F1.pdb"), ("P2", "AF-P2-F1.pdb")}


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m.jsonl")
    manifest.append(path, [{"key": "a", "status": "failed:x", "at": "1"}, {"key": "b", "status": "ok", "at": "1"}])
    manifest.append(path, [{"key": "a", "status": "ok", "at": "2"}, {"key": "c", "status": "failed:late", "at": "2"}])
    with open(path, "a") as f:
        f.write("{broken\n")
    m = manifest.read(spark, path)
    assert {r.status: r.n for r in manifest.counts(m).collect()} == {"ok": 2, "failed": 1}
    keys = spark.createDataFrame([("a",), ("c",), ("d",)], "k string")
    assert {r.k for r in manifest.pending(keys, "k", m).collect()} == {"d"}
    assert {r.k for r in manifest.pending(keys, "k", m, retry_failed=True).collect()} == {"c", "d"}
    assert [(r.key, r.reason) for r in manifest.failures(m).collect()] == [("c", "late")]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    sinks.rebuild(old, path, ["k"])
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "d")], "k bigint, v string")
    assert {(r.k, r.v) for r in sinks.upsert(new, path, ["k"], [F.desc("v")]).collect()} == {(1, "a"), (2, "B"), (3, "d")}
    assert sinks.conform(old, T.StructType.fromDDL("v int, x string")).collect()[0].asDict() == {"v": None, "x": None}
    report = str(tmp_path / "r.json")
    sinks.merge_report(report, {"a": {"n": 1}, "b": {"n": 2}})
    assert sinks.merge_report(report, {"b": {"n": 3}}) == {"a": {"n": 1}, "b": {"n": 3}} == json.load(open(report))


def test_stage_resumes(spark, tmp_path):
    folder, out, log, mark = (str(tmp_path / n) for n in ("in", "out", "log", "mark"))
    spark.range(10).withColumnRenamed("id", "k").coalesce(1).write.parquet(folder)
    work = lambda df: I.within_work_cap(df, df.k, 7)
    go = lambda: I.run_once(I.stream(spark, folder, T.StructType.fromDDL("k bigint")), work, out, log, "k", mark).awaitTermination()
    go()
    go()
    spark.range(10, 12).withColumnRenamed("id", "k").coalesce(1).write.mode("append").parquet(folder)
    go()
    assert spark.read.parquet(out).count() == 8
    assert spark.read.json(log).count() == 12

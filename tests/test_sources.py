import gzip
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rankloom import context
from rankloom.sources import tables as src
from rankloom.streaming import windows


def entity(name, sim, path="a/m.py"):
    return {"file_path": path, "name": name, "signature": name + "(x)", "source_code": "def x", "doc_string": "", "similarity": sim, "start_line": 1, "end_line": 2, "entity_type": "method"}


def test_rankings_archives_and_seeds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in ("org__a-1", "org__b-2"):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"related_entities": {"methods": [entity("f", 0.5), entity("g", 0.9)], "classes": []}}))
    ranked = src.ranking_folder(spark, str(tmp_path / "in"))
    assert sorted((r.instance_id, r["rank"], r.name) for r in ranked.collect())[0] == ("org__a-1", 1, "f")
    out = str(tmp_path / "archive")
    src.write_archive(ranked.withColumn("source", F.lit("s1")), out, 1)
    back = src.ranking_archive(spark, out, "s1", 5).collect()
    assert {(r.instance_id, r["rank"], r.name) for r in back} == {("org__a-1", 1, "f"), ("org__b-2", 1, "f")}
    src.materialise_archive(spark, out, str(tmp_path / "dirs"))
    assert spark.read.json(str(tmp_path / "dirs")).where("source = 's1'").count() == 2
    (tmp_path / "seeds.jsonl").write_text(json.dumps({"instance_id": "i", "ranked_files": [{"file_path": "a"}, {"file_path": "b", "rank": 7}, {"file_path": "a", "rank": 9}]}))
    assert {(r.file, r["rank"]) for r in src.file_seeds(spark, str(tmp_path / "seeds.jsonl")).collect()} == {("a", 1), ("b", 7)}
    (tmp_path / "loc.jsonl").write_text(json.dumps({"instance_id": "i", "found_files": ["b.py", "a.py"], "found_related_locs": {"a.py": ["class: A\nfunction: A.f"], "b.py": ["function: g"]}}))
    assert [(r.file, r.name) for r in src.localizer_output(spark, str(tmp_path / "loc.jsonl"), 2).orderBy("rank").collect()] == [("b.py", "g"), ("a.py", "A")]


def test_datasets_and_ids(spark, tmp_path):
    row = {"repo": "o/r", "instance_id": "o__r-1", "base_commit": "c", "problem_statement": "p", "title": "t"}
    (tmp_path / "lines.jsonl").write_text(json.dumps(row) + "\n")
    (tmp_path / "array.json").write_text(json.dumps([row, row | {"instance_id": "o__r-2"}], indent=1))
    assert src.json_dataset(spark, str(tmp_path / "lines.jsonl")).count() == 1
    rows = src.json_dataset(spark, str(tmp_path / "array.json"), array=True)
    (tmp_path / "ids.txt").write_text('# skip\n\no__r-2\n{"instance_id": "o__r-9"}\n')
    ids = src.id_list(spark, str(tmp_path / "ids.txt"))
    assert sorted(r.instance_id for r in ids.collect()) == ["o__r-2", "o__r-9"]
    assert [r.instance_id for r in src.only_ids(rows, ids).collect()] == ["o__r-2"]
    assert [r.instance_id for r in src.difference(rows, ids, "instance_id").collect()] == ["o__r-1"]
    java = spark.createDataFrame([("x-1", "org", "rep", ("abc",), "T", "B", "diff")], "instance_id string, org string, repo string, base struct<sha:string>, title string, body string, fix_patch string")
    n = src.normalise_dialect(java).first()
    assert (n.repo, n.base_commit, n.problem_statement, n.patch) == ("org/rep", "abc", "T\nB", "diff")


def test_ledgers_and_logs(spark, tmp_path):
    out = str(tmp_path / "ledger")
    df = spark.createDataFrame([("a", 0.5, None), ("b", None, "")], "k string, v double, s string")
    src.write_ledger(df, out, ["k", "s", "v"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "ledger").glob("part-*")))
    assert "a\tNA\t0.500000" in text and "b\tNA\tNA" in text
    assert {(r.k, r.v) for r in src.ledger(spark, out, "k string, s string, v double").collect()} == {("a", 0.5), ("b", None)}
    (tmp_path / "run.log").write_text("start one\nconfig x\ndone 5\ndone 6\nstart two\ndone 7\n")
    rows = src.carried_log(spark, str(tmp_path / "run.log"), {"run": r"start (\w+)", "config": r"config (\w+)"}, r"done (\d+)").orderBy("n").collect()
    assert [(r.run, r.config, r.record) for r in rows] == [("one", "x", "5"), ("one", "x", "6"), ("two", "x", "7")]
    assert src.whole_file_fields(spark, str(tmp_path / "run.log"), {"first": r"start (\w+)"}).first().first == "one"


def test_source_trees_and_slices(spark, tmp_path):
    (tmp_path / "repo" / "a").mkdir(parents=True)
    (tmp_path / "repo" / "a" / "m.py").write_text("x = 1\n")
    (tmp_path / "repo" / "b.txt").write_text("no")
    files = src.source_tree(spark, str(tmp_path / "repo"))
    assert [(r.path, r.content) for r in files.collect()] == [("a/m.py", "x = 1\n")]
    assert {(r.parent, r.child, r.child_is_file) for r in src.folders(files).collect()} == {(".", "a", False), ("a", "a/m.py", True)}
    slices = spark.sql("SELECT DATE'2024-01-01' AS a, DATE'2024-02-10' AS b").select(src.time_slices(F.col("a"), F.col("b"), 30).alias("s")).first().s
    assert [(str(x.start), str(x.end)) for x in slices] == [("2024-01-01", "2024-01-31"), ("2024-01-31", "2024-02-10")]
    key = spark.range(1).select(src.cache_key("m", "r1", F.lit("text")).alias("k")).first().k
    import hashlib

    assert key == hashlib.sha256(b"m@r1\x00text").hexdigest()
    done = spark.createDataFrame([("x",)], "path string")
    assert src.missing(files, done, ["path"]).count() == 1
    commits = spark.createDataFrame([(1, "c1", 5), (1, "c2", 7), (1, "c3", 11)], "k int, id string, t int")
    assert [r.id for r in src.history_until(commits, spark.createDataFrame([(1, 10)], "k int, cutoff int"), "k", "t", 1).collect()] == ["c2"]
    ticket = spark.range(1).select(src.html_ticket(F.lit('<title>T</title><body class=x><p>A <b>b</b></p><i class="reporter">me<</i></body>')).alias("t")).first().t
    assert (ticket.title, ticket.text.split()[:2], ticket.reporter) == ("T", ["A", "b"], "me")
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write(json.dumps({"instance_id": "g", "top_k": 1, "sources": {"s": [entity("f", 1.0)]}}))
    assert src.ranking_archive(spark, str(tmp_path / "x.jsonl.gz"), "s", 3).count() == 1


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    values = {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}
    stream = windows.stream(spark, str(tmp_path / "in"), events.schema)
    got = []
    windows.tumbling(stream, "1 day", ["event_type"], values).writeStream.outputMode("complete").foreachBatch(lambda df, _: (got.clear(), got.extend(map(tuple, df.collect())))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination()
    assert sorted(got, key=str) == sorted(map(tuple, windows.tumbling(events, "1 day", ["event_type"], values).collect()), key=str)
    windows.run_available(windows.deduplicated(windows.stream(spark, str(tmp_path / "in"), events.schema), ["user_id", "ts"], "60 days"), str(tmp_path / "out"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.dropDuplicates(["user_id", "ts"]).count()
    seen = []
    windows.upkeep(windows.stream(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "c3"), lambda df, i: seen.append(df.count()))
    assert sum(seen) == events.count() and len(seen) == 3


def test_vectors_are_cached(spark, tmp_path):
    from pyspark.sql import functions as F

    asked = []

    def embed(new):
        asked.append(sorted(r.text for r in new.collect()))
        return new.select("key", F.array(F.length("text").cast("double")).alias("vector"))

    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id int, text string")
    for _ in range(2):
        got = {r.id: r.vector for r in src.cached_vectors(rows, f"{tmp_path}/cache", embed, "m", "r1").collect()}
        assert got == {1: [1.0], 2: [2.0], 3: [1.0], 4: None}
    src.cached_vectors(rows, f"{tmp_path}/cache", embed, "m", "r2").collect()
    assert asked == [["a", "bb"], [], ["a", "bb"]]


def test_arrow_streams_and_files(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"id": pa.array([1, 2], pa.int64()), "other": ["x", "y"], "text": ["a", None]})
    with pa.OSFile(f"{tmp_path}/one.arrow", "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    with pa.OSFile(f"{tmp_path}/two.arrow", "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    rows = src.arrow_streams(spark, str(tmp_path), "text string, id long").collect()
    assert sorted((r.id, r.text) for r in rows) == [(1, "a"), (1, "a"), (2, None), (2, None)]


@pytest.mark.parametrize("master, named, want", [("local[4]", None, context.LOCAL_CHECKPOINTS), ("local", None, context.LOCAL_CHECKPOINTS), ("local-cluster[3,2,1000]", None, None), ("spark://x:7077", None, None), ("yarn", "hdfs://x/y/", "hdfs://x/y")])
def test_a_shared_folder_is_asked_for_on_clusters(master, named, want):
    get = SimpleNamespace(get=lambda *_: named)
    session = SimpleNamespace(conf=get, sparkContext=SimpleNamespace(master=master, getConf=lambda: get))
    if want is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            context.shared_folder(session)
    else:
        assert context.shared_folder(session) == want

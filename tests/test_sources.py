import json
import os

import pytest
from pyspark.sql import functions as F

from corvane import session
from corvane.sources import readers, sinks
from corvane.streaming import runs as streams


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_documents_and_digests(spark, tmp_path):
    write(tmp_path / "a.txt", "x", "y")
    (tmp_path / "b.MD").write_text("z")
    d = {r.path.rsplit("/", 1)[1]: r.text for r in readers.documents(spark, str(tmp_path)).collect()}
    assert d == {"a.txt": "x\ny\n", "b.MD": "z"}
    (tmp_path / "c.pdf").write_text("z")
    with pytest.raises(Exception, match="unsupported document"):
        readers.documents(spark, str(tmp_path)).collect()
    assert readers.file_digests(spark, str(tmp_path / "b.MD")).first().sha256 == "594e519ae499312b29433b7dd8a97ff068defcba9755b6d5d00e84c524d67b06"
    assert readers.config_digest({"b": 1, "a": 2}) == readers.config_digest({"a": 2, "b": 1})


def test_split_files(spark, tmp_path):
    a = write(tmp_path / "train.txt", "# note", "", " e1 : q:1 ", "nocolon", "e1:q2")
    b = write(tmp_path / "val.txt", "e1:q2", "e2:q1")
    assert {tuple(r) for r in readers.split_refs(spark, a).collect()} == {("e1", "q:1"), ("e1", "q2")}
    assert ("# x", "y") in {tuple(r) for r in readers.split_refs(spark, write(tmp_path / "t.txt", "# x:y"), comments=False).collect()}
    won = readers.first_split_wins({"train": readers.split_refs(spark, a), "val": readers.split_refs(spark, b)})
    assert {(r.exam, r.qid, r.split) for r in won.collect()} == {("e1", "q:1", "train"), ("e1", "q2", "train"), ("e2", "q1", "val")}


def test_json(spark, tmp_path):
    good = write(tmp_path / "c.jsonl", json.dumps({"chunk_id": "c1", "text": "t", "source": "s"}), "")
    assert readers.corpus(spark, good).first().chunk_id == "c1"
    with pytest.raises(Exception, match="without text"):
        readers.corpus(spark, write(tmp_path / "d.jsonl", json.dumps({"chunk_id": "c1"}))).collect()
    with pytest.raises(ValueError):
        readers.require_rows(readers.corpus(spark, write(tmp_path / "e.jsonl", "")), "corpus")
    assert readers.strict_objects(spark, good).count() == 1
    with pytest.raises(Exception, match="not a JSON object"):
        readers.strict_objects(spark, write(tmp_path / "f.jsonl", "[1]")).collect()


def test_both_formats_of_scored_groups(spark, tmp_path):
    lines = [{"query": "q", "persona_id": "p", "document": "d1", "score": 0.4}, {"query": "q", "persona_id": "p", "document": "d2", "score": 0.9}, {"query": "z", "persona_id": "p", "document": "d1", "score": 0.4}, {"other": 1}]
    lines.append({"query": "n", "persona_id": "p", "docs": [{"chunk_id": f"c{i}", "text": f"t{i}", "teacher_score": i / 10} for i in range(4)]})
    path = write(tmp_path / "s.jsonl", *map(json.dumps, lines))
    got = readers.scored_groups(readers.json_lines(spark, path, readers.SCORED), 3).collect()
    assert {(r.query, r.document) for r in got} == {("q", "d1"), ("q", "d2"), ("n", "t1"), ("n", "t2"), ("n", "t3")}
    t = spark.createDataFrame([("q", ["a", "b", "c"]), ("r", [])], "query string, negatives array<string>")
    assert [(r.query, r.negatives) for r in readers.triplet_rows(t, 2).collect()] == [("q", ["a", "b"])]


def test_training_log_and_config_guard(spark, tmp_path):
    log = {"run": "r", "epoch_metrics": [{"epoch": 1, "persona_ids": ["p", "q"], "per_query": {"ndcg": [0.1, 0.2]}}]}
    path = write(tmp_path / "log.json", json.dumps(log))
    assert {(r.pos, r.persona, r.value) for r in readers.training_log(spark, path).collect()} == {(0, "p", 0.1), (1, "q", 0.2)}
    ok = spark.createDataFrame([("c", "ok")], "config_sha256 string, status string")
    assert readers.results_of_one_config(ok) is ok
    with pytest.raises(ValueError):
        readers.results_of_one_config(ok.union(spark.createDataFrame([("d", "ok")])))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "b int, a string")
    sinks.overwrite_json(df, str(tmp_path / "j"))
    sinks.append_json(df, str(tmp_path / "j"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert lines == ['{"a":"x","b":1}'] * 2 + ['{"a":null,"b":2}'] * 2
    sinks.csv_report(df, str(tmp_path / "c"), ["b", "a"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["b", "a"]
    sinks.manifest(df, str(tmp_path / "m"), {"version": 4, "filters": {"on": True}}, {"rows": F.count("*")})
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value) == {"version": 4, "filters": '{"on": true}', "rows": 2}
    docs = spark.createDataFrame([("d1", "a b a"), ("d2", "b")], "k string, t string")
    sinks.write_lexical_index(docs, "k", "t", str(tmp_path / "ix"), 4)
    assert spark.read.parquet(str(tmp_path / "ix/postings")).count() == 3
    sinks.write_vectors(spark.createDataFrame([(1, [3.0, 4.0])], "k int, v array<float>"), "k", "v", str(tmp_path / "v"))
    assert [round(x, 4) for x in spark.read.parquet(str(tmp_path / "v")).first().v] == [0.6, 0.8]


def test_stream_equals_batch(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    rows = spark.createDataFrame([(i % 7, f"2024-01-01 00:00:{i:02}", "ok") for i in range(20)], "k int, at string, status string").withColumn("at", F.to_timestamp("at"))
    rows.coalesce(1).write.json(src)
    streams.ingest(streams.attempts(spark, src, rows.schema), ["k"], "at", "1 hour", out, chk).awaitTermination()
    assert spark.read.parquet(out).count() == 7
    streams.ingest(streams.attempts(spark, src, rows.schema), ["k"], "at", "1 hour", out, chk).awaitTermination()
    assert spark.read.parquet(out).count() == 7  # a restart adds nothing
    w = streams.windowed_counts(streams.attempts(spark, src, rows.schema), "at", "status", "10 seconds", "5 seconds", "1 minute")
    q = w.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("win").agg(F.sum("n")).first()[0] == 40
    s = streams.sessions(streams.attempts(spark, src, rows.schema), "at", "k", "8 seconds", "1 minute")
    q = s.writeStream.format("memory").queryName("ses").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ses").agg(F.sum("n")).first()[0] == 20


def test_materialize(spark):
    df = session.materialize(spark.range(5))
    assert df.count() == 5 and "corvane" in df.inputFiles()[0]


def test_intermediate_tables(spark):
    """They are removed on request and at the end; a cluster without a shared folder is refused."""
    t = session.materialize(spark.range(5))
    path = session._PATHS[t].removeprefix("file://")
    assert t.count() == 5 and os.path.isdir(path)
    session.discard(t)
    assert not os.path.exists(path)
    session.discard(t)  # nothing is left to remove
    kept = session.materialize(spark.range(3))
    where = session._PATHS[kept].removeprefix("file://")
    session.clear(spark)
    assert not os.path.exists(where)

    class Nothing:
        """A session on a cluster that names no folder."""

        master = "spark://host:7077"

        def __getattr__(self, name):
            return self

        def __call__(self, *args):
            return self

        def get(self, *args):
            return None

        def isDefined(self):
            return False

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Nothing())

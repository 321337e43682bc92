"""Files of sessions and concepts, snapshots of several crawls, and budgets with timers over a restart."""

import json

import pytest
from pyspark.sql import functions as F

from siltspark.sources import items, tables
from siltspark.streaming import streams


@pytest.mark.parametrize("kind", ["json", "markdown"])
def test_sessions_as_files(spark, tmp_path, kind):
    rows = [("a/b", 2, "assistant", 'say "hi"\n'), ("a/b", 1, "user", "é"), ("a/b", 0, "system", "no"), ("c", 0, "tool", "out"), ("c", 1, "critic", "x"), ("d", 0, "user", "  "), ("e", 0, "user", None)]
    m = spark.createDataFrame(rows, "session_id string, turn int, role string, content string").repartition(3)
    for _ in range(2):  # a second run overwrites
        items.write_sessions(m, str(tmp_path / "out"), kind, "now")
    files = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert "_SUCCESS" in files and not [n for n in files if "._" in n]
    if kind == "json":
        got = {n: json.loads(t) for n, t in files.items() if n != "_SUCCESS"}
        first = {"session_id": "a/b", "exported_at": "now", "event_count": 2, "events": [{"index": 0, "role": "user", "content": "é"}, {"index": 1, "role": "assistant", "content": 'say "hi"\n'}]}
        assert got["a%2Fb.json"] == first and [e["role"] for e in got["c.json"]["events"]] == ["tool", "critic"] and len(got) == 2
    else:
        assert files["c.md"] == "# Session: c\n\n**Exported**: now\n\n---\n\n#### 🔧 Tool Result\n\n```\nout\n```\n\n### critic\n\nx\n\n\n---\n*2 message turns exported*\n"
        assert files["a%2Fb.md"].count("### ") == 2 and len(files) == 3


def test_concepts_come_back_whole(spark, tmp_path):
    rows = [
        ("tables/orders", "table", 'The "orders"', "a: b\nc", "db://x", ["a b", "c, d", '"q"'], "2024-01-01", {"owner": "me: you", "level": "3"}, "body\n---\nmore"),
        ("x", "ref", "", "", "", [], "", {}, ""), ("deep/er/y", "ref", "Y", None, None, None, None, None, None),
    ]
    schema = "id string, type string, title string, description string, resource string, tags array<string>, timestamp string, extra map<string, string>, body string"
    items.write_concepts(spark.createDataFrame(rows, schema), str(tmp_path / "b"))
    concepts, rejects = items.read_concepts(spark, str(tmp_path / "b"))
    got = {r.id: tuple(r) for r in concepts.collect()}
    assert got == {r[0]: tuple("" if v is None and k not in (5, 7) else ([] if k == 5 else {}) if v is None else v for k, v in enumerate(r)) for r in rows}
    assert rejects.count() == 0
    index = (tmp_path / "b/index.md").read_text()
    assert "concepts: 3" in index and index.index("## ref (2)") < index.index("[Y](deep/er/y.md)") < index.index("[x](x.md)") < index.index("## table (1)")
    assert [r.action for r in tables.read_change_log(spark, str(tmp_path / "b/log.md")).collect()] == ["Added"]
    (tmp_path / "b/bad.md").write_text("---\ntype: t\n")
    (tmp_path / "b/plain.md").write_text("---\ntype: t\ntags: [p, q]\nk: 1\nk: 2\n---\nz")
    concepts, rejects = items.read_concepts(spark, str(tmp_path / "b"))
    row = concepts.where("id = 'plain'").first()
    assert (row.tags, row.extra, row.body) == (["p", "q"], {"k": "1"}, "z") and rejects.count() == 1


def test_no_file_outside_the_folder(spark, tmp_path):
    bad = spark.createDataFrame([("../x", 0, "p")], "path string, position int, piece string")
    with pytest.raises(Exception, match="no place below"):
        items.write_items(bad, str(tmp_path / "in"))
    assert not (tmp_path / "x").exists() and not (tmp_path / "in/_SUCCESS").exists()


def test_crawls(spark, tmp_path):
    path = str(tmp_path)
    one = [("u", "a", None, None, 200), ("v", "a", "e1", None, 200), ("w", "a", None, "mon", 200), ("x", "a", "", "", 200), ("y", "a", "e", None, 200), ("z", "a", None, None, 200)]
    two = [("u", "a", None, None, 200), ("v", "b", "e1", None, 200), ("w", "b", None, "mon", 200), ("x", "b", "", "", 200), ("y", "b", "f", None, 304), ("n", "a", None, None, 200)]
    frame = lambda r: spark.createDataFrame(r, "url string, html string, etag string, last_modified string, status int")
    tables.write_snapshot(frame(one), path, "1")
    tables.write_snapshot(frame(two[:1]), path, "2")
    tables.write_snapshot(frame(two), path, "2")  # replaces itself, and leaves the first
    got = {r.url: (r.status, r.reason) for r in tables.diff_crawls(spark, path, "1", "2").collect()}
    assert got == {"u": ("unchanged", "hash"), "v": ("unchanged", "etag"), "w": ("unchanged", "last-modified"), "x": ("changed", "differs"), "y": ("unchanged", "not modified"), "z": ("removed", "gone"), "n": ("new", "not cached")}
    assert {r.reason for r in tables.diff_crawls(spark, path, "1", "1").where("url = 'x'").collect()} == {"hash"}
    assert tables.read_snapshot(spark, path, "2").count() == 6


def test_budget_timer_fires_without_a_message(spark, tmp_path):
    schema = "session_id int, ts timestamp, content string"

    def send(rows):
        df = spark.createDataFrame(rows, "session_id int, s long, content string").select("session_id", F.timestamp_seconds("s").alias("ts"), "content")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = streams.budget_stream(stream, most_tokens=50, trim=0.0, gap_s=300, late="0 seconds")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.session_id, int(r.ts.timestamp()), r.tokens, r.n, r.reason) for r in rows)

    at = lambda s: 1_700_000_000 + s
    send([(1, at(0), "x" * 40), (1, at(20), "x" * 40), (2, at(10), "x" * 240), (3, at(0), "x" * 8)])
    assert [(i, n, why) for i, _, _, n, why in run()] == [(2, 1, "tokens")]
    send([(3, at(200), "x" * 8)])  # the clock goes on, but not past the gap
    assert len(run()) == 1
    send([(9, at(1000), "x")])  # another session moves the clock: 1 and 3 are due, 2 has nothing to revise
    got = [(i, s - at(0), tokens, n, why) for i, s, tokens, n, why in run()]
    assert got == [(1, 300, 20, 2, "time"), (2, 10, 60, 1, "tokens"), (3, 300, 4, 2, "time")]
    send([(1, at(1100), "x" * 400)])  # forgotten since, so it begins anew
    assert [(s - at(0), n, why) for i, s, _, n, why in run() if i == 1] == [(300, 2, "time"), (1100, 1, "tokens")]

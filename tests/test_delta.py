"""Listings that go on from tokens, and messages with attempts."""

import json
import os
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loamfield.sources import delta
from loamfield.streaming import deliveries, events


def put(spark, at, rows):
    delta.put_answers(spark.createDataFrame([(s, p, json.dumps(b)) for s, p, b in rows], "since string, page string, body string"), at)


def graph(ids, tag, removed=(), **more):
    return {"value": [{"id": i, "eTag": tag, "name": f"n{i}"} for i in ids] + [{"id": i, "deleted": {}} for i in removed], **more}


def test_two_polls(spark, tmp_path):
    answers, at = str(tmp_path / "answers"), str(tmp_path / "at")
    put(spark, answers, [("", "", graph(["1", "2"], "a", **{"@odata.nextLink": "p2"})), ("", "p2", graph(["3"], "a", **{"@odata.deltaLink": "t1"}))])
    delta.poll(spark, at, "onedrive", answers=answers)
    assert {(r.id, r.etag, r.gone) for r in delta.polled_items(spark, at).collect()} == {("1", "a", False), ("2", "a", False), ("3", "a", False)}
    delta.poll(spark, at, "onedrive", answers=answers)  # nothing new
    put(spark, answers, [("t1", "", graph(["2"], "b", removed=["1"], **{"@odata.nextLink": "p2"}))])
    delta.poll(spark, at, "onedrive", answers=answers)  # breaks off after its first page: nothing counts
    assert {(r.id, r.etag) for r in delta.polled_items(spark, at).collect()} == {("1", "a"), ("2", "a"), ("3", "a")}
    put(spark, answers, [("t1", "p2", graph(["4"], "b", removed=["9"], **{"@odata.deltaLink": "t2"}))])
    delta.poll(spark, at, "onedrive", answers=answers)
    want = {("1", "a", True), ("2", "b", False), ("3", "a", False), ("4", "b", False)}
    assert {(r.id, r.etag, r.gone) for r in delta.polled_items(spark, at).collect()} == want
    put(spark, answers, [("t2", "", graph(["1"], "c", **{"@odata.deltaLink": "t3"})), ("t3", "", graph(["5"], "d", **{"@odata.deltaLink": "t4"}))])
    delta.poll(spark, at, "onedrive", answers=answers)  # two traversals in one poll
    got = {(r.id, r.etag, r.gone) for r in delta.polled_items(spark, at).collect()}
    assert got == want - {("1", "a", True)} | {("1", "c", False), ("5", "d", False)}
    steps = spark.read.parquet(f"{at}/items").groupBy("step").count().count()
    assert steps == 3  # polls without news write nothing


def test_one_traversal(spark, tmp_path):
    answers = str(tmp_path / "answers")
    spark.dataSource.register(delta.Listing)
    put(spark, answers, [("", "", {"entries": [], "cursor": "c", "has_more": True})])
    read = lambda **o: spark.read.format("listing").options(service="dropbox", answers=answers, **o).load()
    assert [(r.page, r.complete) for r in read().collect()] == [("", False)]
    assert read(since="nowhere").count() == 0
    put(spark, answers, [("", "c", {"entries": [], "cursor": "c2", "has_more": False})])
    assert sorted((r.place, r.page, r.complete) for r in read(pages_per_task="1").collect()) == [(0, "", True), (1, "c", True)]


def test_tokens(spark, tmp_path):
    assert delta.follows('{"cursor": "c", "has_more": true}', "dropbox") == ("c", None)
    assert delta.follows('{"cursor": "c", "has_more": false}', "dropbox") == (None, "c")
    assert delta.follows('{"next_page": "u", "end_of_stream": true, "end_time": 5}', "zendesk_tickets") == (None, "5")
    assert delta.follows('{"next_stream_position": 7, "chunk_size": 0}', "box") == (None, "7")
    page = lambda *times, **o: {"results": [{"last_edited_time": t} for t in times], **o}
    assert delta.follows(json.dumps(page("2", "3", has_more=True, next_cursor="x")), "notion") == ("x", "3")
    for name in delta.PAGING:
        assert delta.follows("{}", name) == (None, None)
    answers = str(tmp_path / "answers")
    o = {"service": "notion", "answers": answers}
    rows = [("", page("9", "8", has_more=True, next_cursor="x")), ("x", page("5", has_more=True, next_cursor="y")), ("y", page("1", has_more=False))]
    put(spark, answers, [(s, p, b) for s in ("", "5") for p, b in rows])
    assert delta.traverse(o, "") == (["", "x", "y"], "9")
    assert delta.traverse(o | {"newest_first": "true"}, "5") == ([""], "9")  # the second page has nothing newer
    assert delta.traverse(o, "none") == ([], None)
    put(spark, answers, [("loop", "", page("1", has_more=True, next_cursor="a")), ("loop", "a", page("1", has_more=True, next_cursor="a"))])
    with pytest.raises(ValueError, match="follows itself"):
        delta.traverse(o, "loop")


def test_fetch_by_http():
    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if "since=t%201" in self.path and self.headers["X-Key"] == "k" else 404)
            self.end_headers()
            self.wfile.write(b"{}")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    o = {"url": f"http://127.0.0.1:{server.server_port}/?since={{since}}&page={{page}}", "headers": '{"X-Key": "k"}'}
    try:
        assert delta.fetch(o, "t 1", "") == "{}" and delta.fetch(o, "t2", "") is None
        assert delta.fetch(o, "t2", o["url"].format(since="t%201", page="")) == "{}"
    finally:
        server.shutdown()


def stream_of(spark, at, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "message string, attempt int, ts string, outcome string").withColumn("ts", F.expr("cast('2024-01-01 ' || ts as timestamp)")).coalesce(1).write.parquet(f"{at}/{i}.parquet")
        for f in Path(f"{at}/{i}.parquet").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    schema = spark.read.parquet(f"{at}/0.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/*.parquet")


def test_messages_are_settled(spark, tmp_path):
    first = [
        ("ok", 1, "00:00", "retry"), ("ok", 2, "00:10", "done"), ("ok", 2, "00:10", "done"),
        ("thrice", 3, "00:30", None), ("thrice", 1, "00:00", "retry"), ("thrice", 2, "00:10", "retry"),
        ("bad", 1, "00:05", "fatal"), ("bad", 2, "00:06", "done"),
        ("slow", 1, "00:00", "retry"), ("later", 1, "00:00", "retry"), ("twice", 1, "00:00", "retry"), ("twice", 1, "00:00", "retry"),
        (None, 1, "00:00", "done"),
    ]
    second = [("later", 2, "00:40", "done"), ("ok", 3, "00:50", "fatal"), ("slow", 2, "09:00", "done"), ("twice", 1, "00:00", "retry"), ("twice", 2, "00:55", "retry"), ("new", 1, "09:00", "retry")]
    third = [("clock", 1, "12:00", "retry"), ("bad", 3, "11:59", "done"), ("thrice", 4, "00:35", "done")]
    stream = stream_of(spark, str(tmp_path), [first, second, third])
    with deliveries.state_store(spark):
        got = events.settle(deliveries.settled(stream, 3), "messages", "append").collect()
    want = {
        ("ok", "done", 2, None), ("thrice", "dead", 3, "attempts"), ("bad", "dead", 1, "fatal"), ("slow", "abandoned", 1, "deadline"),
        ("later", "done", 2, None), ("twice", "abandoned", 2, "deadline"), (None, "done", 1, None),
    }
    assert {(r.message, r.status, r.attempts, r.cause) for r in got} == want and len(got) == len(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_messages_share_calls_and_state(spark, tmp_path):
    rng = random.Random(11)
    batches, tries, n = [], {}, 0
    for hour in range(4):  # each batch is an hour, in which all come in time
        rows = []
        for _ in range(600):
            m, n = f"m{rng.randrange(900)}", n + 1
            t = hour * 3600 + rng.randrange(3600)
            row = (m, n, f"{t // 3600:02}:{t % 3600 // 60:02}:{t % 60:02}", rng.choice(["retry", "retry", "done", "fatal", None]))
            rows += [row] * rng.randint(1, 2)
            tries.setdefault(m, []).append((hour, t, str(n), row[3]))
        batches.append(rows)
    batches.append([("end", 0, "23:00", "done")])
    want = {("end", "done", 1, None)}
    for m, all_of in tries.items():
        tried = 0
        for _, _, _, o in sorted(all_of):  # batch by batch
            tried += 1
            if o in ("done", "fatal") or tried == 3:
                want.add((m, "done" if o == "done" else "dead", tried, None if o == "done" else "fatal" if o == "fatal" else "attempts"))
                break
        else:
            want.add((m, "abandoned", tried, "deadline"))
    out = str(tmp_path / "out")
    stream = deliveries.settled(stream_of(spark, str(tmp_path / "in"), batches), 3, buckets=16)
    with deliveries.state_store(spark):
        query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(out)
        query.awaitTermination()
    got = [(r.message, r.status, r.attempts, r.cause) for r in spark.read.parquet(out).collect()]
    assert set(got) == want and len(got) == len(want)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert 0 < max(held) <= 16 and len(tries) > 700  # a row of the store for many messages

"""Session logs: line rules, state, increments, manifest."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from meterlake.sources import logs


def claude(request="r1", out=10, model="claude-opus-9-1", ts="2025-03-04T05:06:07.089Z", **usage):
    return {"type": "assistant", "requestId": request, "timestamp": ts, "sessionId": "s", "message": {"model": model, "usage": {"input_tokens": 5, "output_tokens": out, **usage}}}


def write(path, rows, tail="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + tail)


def states(spark, root, parse=logs.parse_claude):
    return [(r["pos"], r["state"]) for r in parse(logs.discover(spark, str(root))).orderBy("path", "pos").collect()]


def test_claude_line_rules(spark, tmp_path):
    bad = lambda **u: claude(**u)
    rows = [
        claude(), {"type": "user", "timestamp": "2026-01-01T00:00:00Z"}, claude(request=""), claude(model="<synthetic>"), "{broken", bad(input_tokens=None), bad(input_tokens=-1),
        bad(input_tokens="7"), bad(input_tokens=1.5), bad(input_tokens=9223372036854775808), claude(ts="2025-03-04T05:06:07"), {"type": 7}, {"type": "assistant", "requestId": "x"},
    ]
    write(tmp_path / "projects" / "demo" / "a.jsonl", rows)
    want = ["kept", "skipped", "skipped", "skipped", "bad", "bad", "bad", "bad", "bad", "bad", "bad", "bad", "skipped"]
    assert [s for _, s in states(spark, tmp_path)] == want


def test_largest_output_of_a_request_wins(spark, tmp_path):
    write(tmp_path / "projects" / "demo" / "a.jsonl", [claude(out=4), claude(out=17), claude(out=9)])
    out = logs.kept_records(logs.parse_claude(logs.discover(spark, str(tmp_path))), "claude-code").collect()
    assert [(r["output_tokens"], r["pos"]) for r in out] == [(17, 1)]


def test_cache_split_and_dimensions(spark, tmp_path):
    split = {"ephemeral_5m_input_tokens": 30, "ephemeral_1h_input_tokens": 12}
    rows = [claude("a", cache_creation=split), claude("b", cache_creation=split, cache_creation_input_tokens=100, service_tier=" ", speed="fast")]
    write(tmp_path / "projects" / "-home-me-src-my-app" / "s" / "subagents" / "x.jsonl", rows)
    out = {r["request_id"]: r for r in logs.kept_records(logs.parse_claude(logs.discover(spark, str(tmp_path))), "claude-code").collect()}
    assert (out["a"]["cache_creation_tokens"], out["b"]["cache_creation_tokens"]) == (42, 100)
    assert (out["b"]["service_tier"], out["b"]["speed"], out["b"]["project"], out["b"]["is_subagent"]) == (None, "fast", "my-app", True)


def test_tail_waits_but_a_whole_last_line_counts(spark, tmp_path):
    write(tmp_path / "a.jsonl", [claude("a"), '{"type": "assis'], tail="")
    write(tmp_path / "b.jsonl", [claude("b")], tail="")
    assert states(spark, tmp_path) == [(0, "kept"), (1, "tail"), (0, "kept")]
    parsed = logs.parse_claude(files := logs.discover(spark, str(tmp_path)))
    sizes = {r["path"].rsplit("/", 1)[1]: (r["size"], r["consumed"]) for r in logs.consumed(parsed, files).collect()}
    assert sizes["b.jsonl"][0] == sizes["b.jsonl"][1] and sizes["a.jsonl"][1] == sizes["a.jsonl"][0] - len('{"type": "assis')


def codex_rows():
    count = lambda **u: {"timestamp": "2025-08-09T10:11:12.013Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": u, "total_token_usage": {"input_tokens": 5000}}}}
    return [
        count(input_tokens=1), {"timestamp": "t", "type": "session_meta", "payload": {"id": "sess", "cwd": "/home/me/proj/"}}, {"timestamp": "t", "type": "turn_context", "payload": {"model": "gpt-9"}},
        count(input_tokens=310, cached_input_tokens=120, output_tokens=45, reasoning_output_tokens=11), count(input_tokens="x"), {"type": "event_msg"},
        {"timestamp": "2025-08-09T11:30:00Z", "type": "event_msg", "payload": {"type": "token_count", "usage": {"input_tokens": 3, "input_token_details": {"cached_tokens": 2}}}},
        count(input_tokens=310, cached_input_tokens=120, output_tokens=45, reasoning_output_tokens=11),
    ]


def test_codex_state_and_usage_places(spark, tmp_path):
    write(tmp_path / "sessions" / "a.jsonl", codex_rows())
    parsed = logs.parse_codex(logs.discover(spark, str(tmp_path)))
    assert [r["state"] for r in parsed.orderBy("pos").collect()] == ["skipped", "skipped", "skipped", "kept", "skipped", "bad", "kept", "kept"]
    out = logs.kept_records(parsed, "codex").orderBy("timestamp").collect()
    assert [(r["request_id"], r["model_id"], r["project"], r["cached_input_tokens"]) for r in out] == [
        ("sess:2025-08-09T10:11:12.013+00:00:310:120:45:11:standard", "gpt-9", "proj", 120), ("sess:2025-08-09T11:30:00+00:00:3:2:0:0:standard", "gpt-9", "proj", 2),
    ]


def test_ingest_in_steps(spark, tmp_path):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    write(root / "projects" / "demo" / "a.jsonl", [claude("a"), "{bad"])
    roots = {"claude-code": str(root), "codex": str(tmp_path / "missing")}
    first = {r["provider"]: r for r in logs.ingest(spark, roots, store).collect()}
    assert (first["claude-code"]["inserted"], first["claude-code"]["parse_errors"], first["codex"]["discovered"]) == (1, 1, 0)
    again = {r["provider"]: r for r in logs.ingest(spark, roots, store).collect()}
    assert (again["claude-code"]["processed"], again["claude-code"]["inserted"]) == (0, 0)
    write(root / "projects" / "demo" / "a.jsonl", [claude("a"), "{bad", claude("b")])
    grown = {r["provider"]: r for r in logs.ingest(spark, roots, store).collect()}
    assert (grown["claude-code"]["processed"], grown["claude-code"]["inserted"], grown["claude-code"]["parse_errors"]) == (1, 1, 0)
    assert spark.read.parquet(f"{store}/usage").count() == 2
    rebuilt = {r["provider"]: r for r in logs.ingest(spark, roots, store, rebuild=True).collect()}
    assert rebuilt["claude-code"]["inserted"] == 2 and spark.read.parquet(f"{store}/usage").count() == 2


def test_a_rebuild_forgets_what_no_log_has(spark, tmp_path):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    write(root / "projects" / "a" / "a.jsonl", [claude("a"), claude("b", ts="2025-04-05T00:00:00Z")])
    write(root / "projects" / "b" / "b.jsonl", [claude("c", ts="2025-05-06T00:00:00Z")])
    write(tmp_path / "other" / "x.jsonl", codex_rows())
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    logs.ingest(spark, {"claude-code": str(root), "codex": str(tmp_path / "other")}, store).collect()
    stored = lambda: sorted((r["provider"], r["request_id"].split(":")[0]) for r in spark.read.parquet(f"{store}/usage").collect())
    codex = [x for x in stored() if x[0] == "codex"]
    assert codex and stored() == [("claude-code", x) for x in "abc"] + codex
    (root / "projects" / "b" / "b.jsonl").unlink()
    logs.ingest(spark, {"claude-code": str(root)}, store, rebuild=True).collect()
    assert stored() == [("claude-code", x) for x in "ab"] + codex
    # the file comes back as it was: it is new again
    write(root / "projects" / "b" / "b.jsonl", [claude("c", ts="2025-05-06T00:00:00Z")])
    logs.ingest(spark, {"claude-code": str(root)}, store).collect()
    assert stored() == [("claude-code", x) for x in "abc"] + codex
    for f in root.rglob("*.jsonl"):
        f.unlink()
    logs.ingest(spark, {"claude-code": str(root)}, store, rebuild=True).collect()
    assert stored() == codex and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def test_a_file_that_cannot_be_read_is_reported(spark, tmp_path):
    write(tmp_path / "a.jsonl", [claude("a"), "{bad"])
    write(tmp_path / "b.jsonl", [claude("b")])
    found = logs.listing(spark, str(tmp_path))
    lost = found.unionByName(found.limit(1).withColumn("path", F.lit(str(tmp_path / "gone.jsonl"))))
    files = logs.read(lost.withColumn("offset", F.lit(0))).cache()
    parsed = logs.parse_claude(files.filter("value is not null"))
    report = logs.ingest_report("claude-code", lost, files, parsed, logs.kept_records(parsed, "claude-code")).first()
    assert (report["discovered"], report["processed"], report["file_errors"], report["inserted"], report["parse_errors"]) == (3, 2, 1, 2, 1)
    assert {(r["path"].rsplit("/", 1)[1], r["bad_lines"]) for r in logs.parse_findings(parsed, files).collect()} == {("a.jsonl", 1), ("gone.jsonl", None)}


def test_many_lines_in_one_file(spark, tmp_path):
    write(tmp_path / "a.jsonl", ["x" * (i % 7) or "y" for i in range(100_000)])
    found = logs.lines(logs.discover(spark, str(tmp_path))).orderBy(F.desc("pos")).first()
    assert found["pos"] == 99_999 and found["start"] == sum(max(1, i % 7) + 1 for i in range(99_999)) and found["ended"]


def test_invalid_records_stop_the_batch(spark, tmp_path):
    write(tmp_path / "a.jsonl", [claude("ok"), claude("  ")])
    records = logs.kept_records(logs.parse_claude(logs.discover(spark, str(tmp_path))), "claude-code")
    with pytest.raises(logs.InvalidRecord):
        logs.validate(records)


def test_manifest_keeps_the_latest(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    old = spark.createDataFrame([("codex", "/a", 1, t(1), 1, t(1)), ("codex", "/b", 1, t(1), 1, t(1))], logs.MANIFEST)
    new = spark.createDataFrame([("codex", "/a", 9, t(2), 9, t(2))], logs.MANIFEST)
    assert sorted((r["path"], r["size"]) for r in logs.upsert_manifest(old, new).collect()) == [("/a", 9), ("/b", 1)]


def ingested(spark, root, store, **more):
    got = logs.ingest(spark, {"claude-code": str(root)}, store, **more).first()
    rows = sorted(r["request_id"] for r in logs.stored_usage(spark, store).collect())
    return (got["processed"], got["inserted"], got["parse_errors"], got["status"]), "".join(rows)


def test_files_that_grow_shrink_are_touched_or_lose_their_tail(spark, tmp_path):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    file = root / "projects" / "demo" / "a.jsonl"
    write(file, [claude("a"), "{bad", claude("b")], tail='\n{"type": "assis')
    assert ingested(spark, root, store) == ((1, 2, 1, "partial"), "ab")
    # grown: only what follows is read, and the line that was half written is whole now
    write(file, [claude("a"), "{bad", claude("b"), claude("c"), claude("d")])
    assert ingested(spark, root, store) == ((1, 2, 0, "ok"), "abcd")
    assert ingested(spark, root, store) == ((0, 0, 0, "unchanged"), "abcd")
    # touched: all is read, all of it is known
    os.utime(file, (file.stat().st_atime, file.stat().st_mtime + 10))
    assert ingested(spark, root, store) == ((1, 0, 1, "partial"), "abcd")
    # shrunk, but longer than a part of it that was consumed before: all is read
    write(file, [claude("e"), "{bad", claude("f")])
    assert ingested(spark, root, store) == ((1, 2, 1, "partial"), "abcdef")
    # its tail is lost within a line
    text = file.read_text()
    file.write_text(text[:-20])
    assert ingested(spark, root, store) == ((1, 0, 1, "partial"), "abcdef")
    file.write_text(text)
    assert ingested(spark, root, store) == ((1, 0, 0, "ok"), "abcdef")
    file.unlink()
    assert ingested(spark, root, store) == ((0, 0, 0, "missing"), "abcdef")


def test_state_is_carried_over_the_offset(spark, tmp_path):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    write(root / "a.jsonl", codex_rows()[:4])
    assert logs.ingest(spark, {"codex": str(root)}, store).first()["inserted"] == 1
    write(root / "a.jsonl", codex_rows())
    got = logs.ingest(spark, {"codex": str(root)}, store).first()
    assert (got["inserted"], got["parse_errors"]) == (1, 1)
    assert {r["model_id"] for r in logs.stored_usage(spark, store).collect()} == {"gpt-9"}


@pytest.mark.parametrize("split", ["128m", "3000b"])
def test_splits_of_one_file(spark, tmp_path, split):
    """Offsets, positions and carried state do not depend on how a file is dealt."""
    rows = [("é" * (i % 9) + f"x{i}" if i % 5 else "") for i in range(9_000)]
    write(tmp_path / "lines" / "a.jsonl", rows, tail="\ntail")
    (tmp_path / "lines" / "empty.jsonl").write_text("")
    (tmp_path / "lines" / "blank.jsonl").write_text("\n\n")
    write(tmp_path / "codex" / "a.jsonl", codex_rows()[:3] + codex_rows()[3:4] * 300)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(keys[0], split)
        spark.conf.set(keys[1], "0")
        files = logs.discover(spark, str(tmp_path / "lines"))
        got = sorted((r["pos"], r["start"], r["line"], r["ended"], r["split"]) for r in logs.lines(files).collect())
        assert (len({r[4] for r in got}) > 20) == (split == "3000b")
        start, want = 0, []
        for i, line in enumerate([*rows, "tail"]):
            if line:
                want.append((i, start, line, line != "tail"))
            start += len(line.encode()) + 1
        assert [r[:4] for r in got] == want
        assert logs.consumed(logs.parse_claude(files), files).count() == 2  # an empty file is not listed
        parsed = logs.parse_codex(logs.discover(spark, str(tmp_path / "codex")))
        assert [r["state"] for r in parsed.orderBy("pos").collect()] == ["skipped"] * 3 + ["kept"] * 300
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_an_ingest_that_stops_half_way_counts_for_nothing(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    write(root / "a.jsonl", [claude("a")])
    assert ingested(spark, root, store)[1] == "a"
    seen = lambda: ("".join(sorted(r["request_id"] for r in logs.stored_usage(spark, store).collect())), logs.stored_manifest(spark, store).count())
    for rebuild in (False, True):
        before = seen()
        write(root / "a.jsonl", [claude("a"), claude("b" if not rebuild else "c")])
        whole = logs.publish

        def stop(*_):
            raise RuntimeError("stopped")

        monkeypatch.setattr(logs, "publish", stop)  # usage, manifest and mark of the rebuild are written by then
        with pytest.raises(RuntimeError, match="stopped"):
            logs.ingest(spark, {"claude-code": str(root)}, store, rebuild=rebuild)
        monkeypatch.setattr(logs, "publish", whole)
        assert seen() == before
        assert ingested(spark, root, store, rebuild=rebuild)[1] == ("ac" if rebuild else "ab")
    with pytest.raises(RuntimeError, match="there already"):
        logs.publish(spark, store, logs.current(spark, store))


def test_records_out_of_range(spark, tmp_path):
    write(tmp_path / "a.jsonl", [claude("ok"), claude("big", out=2**63 - 1), claude("fits", out=2**63 - 6)])
    records = logs.kept_records(logs.parse_claude(logs.discover(spark, str(tmp_path))).withColumn("total_tokens", F.lit(0)), "claude-code")
    assert [r["request_id"] for r in logs.invalid_records(records).collect()] == ["big"]


@pytest.mark.parametrize("keys", [["k"], ["k", "g"]])
def test_carried_in_chunks(spark, keys):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([0, None]), i, rng.choice([None, None, f"v{i}"]), rng.choice([None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, g int, i long, v string, w long").repartition(5)
    whole = logs.carried(df, keys, ["i"], {"v": "x", "w": "y"}).orderBy("i").collect()
    for size in (1, 7, 600):
        assert logs.carried(df, keys, ["i"], {"v": "x", "w": "y"}, F.floor(F.col("i") / size)).orderBy("i").collect() == whole


def test_a_day_of_a_small_ingest_is_one_file(spark, tmp_path):
    """Files of usage grow with days and bytes, not with days times tasks."""
    root, store = tmp_path / "logs", str(tmp_path / "store")
    for p in range(3):
        write(root / "projects" / f"p{p}" / "a.jsonl", [claude(f"r{p}-{i}", ts=f"2025-03-{1 + i % 5:02d}T05:06:07Z") for i in range(60)])
    assert logs.ingest(spark, {"claude-code": str(root)}, store).first()["inserted"] == 180
    assert len(list((tmp_path / "store" / "usage").rglob("*.parquet"))) == 5


def test_one_order_finds_the_first_file_and_its_most_output(spark):
    rng = random.Random(2)
    rows = [("claude-code", f"r{rng.randrange(40)}", f"/p{rng.randrange(4)}", i, rng.randrange(5), "kept") for i in range(500)]
    df = spark.createDataFrame(rows, "provider string, request_id string, path string, pos long, output_tokens long, state string")
    assert sorted(logs.kept_records(df, "claude-code").collect()) == sorted(logs.first_wins(logs.max_output_wins(df)).collect())

import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from replicalens import __main__ as cli
from replicalens.operators import conflicts, outcomes, projects, records, shape
from replicalens.sources import ingest, sinks, state


def sha(x):
    return hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def test_digests_are_those_of_pythons_json(spark):
    known = {"p": ["a", "b\"\\"], "é": ["x\ty", "\u200b"]}
    rows = [(p, n) for p, names in known.items() for n in names] * 2
    assert records.known_set_hash(spark.createDataFrame(rows, "project_key string, name string")).first()[0] == sha(known)
    files = [("p", n, n * 2) for n in ("b.json", "a.json", "acks.json", "x.lock", "y.tmp")]
    assert records.marker_digests(spark.createDataFrame(files, "project_key string, name string, raw_sha256 string")).first()[1] == sha([["a.json", "a.jsona.json"], ["b.json", "b.jsonb.json"]])
    assert records.config_hash(None, {}, True) == sha({"own_hub": None, "remotes": {}, "force_unsafe_lock": True})
    frame = lambda r, s: spark.createDataFrame(r, s)
    got = records.state_entries(frame([("p", "s", "/w", "d"), ("q", "t", None, "e")], "project_key string, sid string, cwd string, local_dir string"), frame([("hub", "p", "s"), ("local", "q", "t")], "side string, project_key string, name string"), frame([("/w", "p")], "cwd string, bound string"), frame([("e", "q")], "local_dir string, bound string"), frame([("e",)], "local_dir string"))
    want = {"s": {"pk": "p", "sid": "s", "known": True, "local_known": False, "binding": "p", "dir_binding": None, "dir_asserted": False}, "t": {"pk": "q", "sid": "t", "known": False, "local_known": True, "binding": None, "dir_binding": "q", "dir_asserted": True}}
    assert {r.sid: r.state_entry for r in got.collect()} == {k: sha(v) for k, v in want.items()}


def test_markers_and_coverage_read_back(spark, tmp_path):
    rows = [("p", "session", "s1", "1" * 64, None), ("p", "memory", "a.md", None, "a"), ("p", "memory", "b.md", "x", None)]
    deleted = spark.createDataFrame(rows, "project_key string, kind string, target string, base_hash string, identity string")
    (tmp_path / "p").mkdir()
    assert sinks.write_texts(records.marker_files(deleted, "m\"x", "t"), str(tmp_path), ".tombstones") == 3
    assert sinks.write_texts(records.coverage_files(deleted.select("project_key"), "m", "t"), str(tmp_path), ".tombstones", replace=False) == 1
    (tmp_path / "p/.tombstones/s2.deleted.json").write_text("{}")
    (tmp_path / "p/.tombstones/.deleted.json").write_text("{}")
    (tmp_path / "p/.tombstones/s3.deleted.json").write_text('{"kind": "session", "target": "s3", "time": 5}')
    files = ingest.read_files(ingest.list_paths(spark, {"hub": str(tmp_path)}, "tombstone"))
    got = {(r.kind, r.target, r.base_hash, r.identity, r.machine, r.valid) for r in ingest.tombstones(files).collect()}
    assert got == {("session", "s1", "1" * 64, None, 'm"x', True), ("memory", "a.md", None, "a", 'm"x', True), ("memory", "b.md", "x", None, 'm"x', True), ("session", "s2", None, None, None, False), ("session", "s3", None, None, None, False)}
    assert [(r.project_key, r.initialized, r.epoch) for r in ingest.coverage(files).collect()] == [("p", True, 1)]


@pytest.mark.parametrize("text, sound", [('{"initialized": true, "epoch": 0}', True), ('{"initialized": true, "epoch": 1, "machine": 3}', False), ('{"initialized": true, "epoch": true}', False), ('{"initialized": "true", "epoch": 1}', False), ('{"initialized": false, "epoch": 1, "bootstrap_time": null, "schema_version": 9}', True), ("[]", False), ("{", False)])
def test_coverage_rules(spark, text, sound):
    files = spark.createDataFrame([("hub", "p", "_coverage.json", "", bytearray(text.encode()), "")], ingest.FILES)
    assert ingest.coverage(files).count() == sound


def test_records_of_projects_and_sessions(spark, tmp_path):
    (tmp_path / "p/memory").mkdir(parents=True)
    (tmp_path / "q").mkdir()
    (tmp_path / "p/_project.json").write_text(json.dumps({"git_remote": "h/a", "first_commit": "c", "observed_cwds": ["/x"]}))
    (tmp_path / "q/_project.json").write_text(json.dumps({"git_remote": 3}))
    meta = {"content_hash": "a" * 64, "tail_hash": "b" * 64, "line_count": 2, "uuid_count": 1, "non_uuid_count": 1}
    (tmp_path / "p/s.meta.json").write_text(json.dumps(meta))
    (tmp_path / "p/t.meta.json").write_text(json.dumps(meta | {"line_count": True}))
    for name in ("a.MD", "Memory.md", "MEMORY.MD", ".b.md"):
        (tmp_path / "p/memory" / name).write_text("x")
    (tmp_path / "p/memory/l.md").symlink_to(tmp_path / "p/memory/a.MD")
    roots = {"hub": str(tmp_path)}
    files = ingest.read_files(ingest.list_paths(spark, roots, "record"))
    assert [tuple(r) for r in ingest.project_sidecars(files).collect()] == [("p", "h/a", "c", None, ["/x"])]
    assert [(r.sid, r.line_count) for r in ingest.session_metas(files).collect()] == [("s", 2)]
    assert [r.name for r in ingest.list_paths(spark, roots, "memory").collect()] == ["a.MD"]
    assert [tuple(r) for r in ingest.linked_documents(spark, roots).collect()] == [("hub", "p")]


def test_meta_of_torn_and_empty_files(spark):
    lines = [("s1", 0, "u", "h1"), ("s1", 1, "u", "h2"), ("s2", 0, "u", "h1"), ("s2", 1, "u", "h1")]
    rows = spark.createDataFrame(lines, "sid string, idx int, uuid string, canon_hash string").selectExpr("'local' AS side", "'p' AS project_key", "*", "true AS ok")
    files = spark.createDataFrame([("local", "p", s, x) for s, x in (("s1", "ok"), ("s2", "ok"), ("s3", "zero_byte"))], "side string, project_key string, sid string, state string")
    got = {r.sid: r for r in shape.session_meta(rows, files).collect()}
    assert got["s1"].content_hash is None and got["s2"].content_hash == hashlib.sha256(b"h1\nh1\n").hexdigest() and got["s3"].content_hash is None and got["s3"].line_count == 0
    assert shape.session_meta(rows).where("content_hash IS NULL").count() == 1


def test_state_commits_lose_nothing(tmp_path):
    path = str(tmp_path / "deep" / "state.json")
    jobs = [threading.Thread(target=state.commit, args=(path, ("session", "memory")[i % 2], "p", f"n{i}")) for i in range(12)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    got = state.commit(path, "session", "q", "x", cwd="/w", fingerprint="f")
    assert len(got["known_sessions"]["p"]) == len(got["known_memory"]["p"]) == 6 and got["bindings"] == {"/w": "q"} and got["hub_fingerprint"] == "f"
    assert state.reconcile(path, "session", "p", ["a"], [], require=True)["local_sessions"] == {}
    state.reconcile(path, "session", "p", ["a", "b", "c"], [])
    assert state.reconcile(path, "session", "p", ["a"], ["b"], require=True)["local_sessions"]["p"] == ["a", "c"]
    with state.locked(path), pytest.raises(state.Locked):
        state.update(path, lambda s: None, timeout=0.1)


def test_a_fork_is_ambiguous(spark):
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    local, hub = frame([("a", "g@h:x/y"), ("b", "g@h:x/z"), ("c", None)], "dir string, url string"), frame([("H", "g@h:x/y"), ("I", "g@h:q/z")], "dir string, url string")
    commits = lambda rows: frame(rows, "dir string, first_commit string")
    got = projects.remote_matches(local, hub, commits([("a", "1"), ("b", "2"), ("c", None)]), commits([("H", "1"), ("I", "2"), ("J", None)]))
    assert {r.local_dir: (r.status, r.hub_dir) for r in got.collect()} == {"a": ("match", "H"), "b": ("ambiguous", None), "c": ("needs-map", None)}


def test_deletions_come_first(spark):
    """A copy that the markers of this very run would undo is not made."""
    plan = spark.createDataFrame([("p", "gone.md", "local-deleted"), ("p", "same.md", "copy-to-local")], "project_key string, name string, action string")
    after = plan.withColumn("action", F.when(F.col("name") == "same.md", "suppressed-deleted").otherwise("suppressed-deleted"))
    states = spark.createDataFrame([("p", True, None)], "project_key string, initialized boolean, allowed boolean")
    got = {r.name: r.result for r in outcomes.memory_outcomes(plan, plan, after, states).collect()}
    assert got == {"gone.md": "tombstoned-local-deletion", "same.md": "suppressed"}


def test_bootstrap_then_status_and_halt(spark, tmp_path, capsys):
    local, hub, path = tmp_path / "l", tmp_path / "h", str(tmp_path / "state.json")
    for root, names in ((local, "ab"), (hub, "bc")):
        (root / "p/memory").mkdir(parents=True)
        for n in names:
            (root / f"p/{n}.jsonl").write_text(json.dumps({"uuid": n, "type": "user"}) + "\n")
        (root / f"p/memory/{names}.md").write_text(f"---\nname: {names}\n---\nx\n")
    roots = ["--local", str(local), "--hub", str(hub), "--state", path]
    assert cli.main(["bootstrap", *roots, "--apply", "--ignore", "c"]) == 0
    record = state.load(path)
    assert record["known_sessions"] == {"p": ["b"]} and record["local_sessions"] == {"p": ["a", "b"]} and record["known_memory"] == {"p": ["bc.md"]}
    capsys.readouterr()
    assert cli.main(["status", *roots]) == 0
    assert "p/a: [copy-to-hub]" in (out := capsys.readouterr().out) and "p/c: [copy-to-local]" in out
    assert cli.main(["nudge", *roots]) == 0 and capsys.readouterr().out == "2 to update, 0 to merge\n"
    assert cli.main(["index", *roots, "--apply"]) == 0 and "[ab](ab.md)" in (local / "p/memory/MEMORY.md").read_text()
    (hub / "other").mkdir()
    assert cli.main(["status", *roots]) == 2 and "hub-fingerprint-changed" in capsys.readouterr().out


def test_components_of_long_chains(spark):
    rows = [("p", f"f{i:03}", f"n{k}") for i in range(120) for k in (i, i + 1)] + [("p", "z1", "zz"), ("p", "z2", "zz"), ("q", "f001", "n0"), ("q", "a", None)]
    got = {(r.project_key, r.filename): r.component for r in conflicts.components(spark.createDataFrame(rows, "project_key string, filename string, name string")).collect()}
    assert got == {("p", f"f{i:03}"): "f000" for i in range(120)} | {("p", "z1"): "z1", ("p", "z2"): "z1", ("q", "f001"): "f001"}

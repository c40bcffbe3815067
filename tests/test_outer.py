import json

import pytest
from pyspark.sql import functions as F

from replicalens import __main__ as cli
from replicalens.operators import diagnose, memory, outcomes, staging
from replicalens.sources import state


def test_state_round_trip_and_corruption(spark, tmp_path):
    path = str(tmp_path / "state.json")
    assert state.load(path) is None
    record = state.empty() | {"known_sessions": {"p": ["b", "a"], "q": []}}
    state.save(path, record)
    assert state.load(path)["known_sessions"] == {"p": ["a", "b"], "q": []}
    rows, present = state.tables(spark, state.load(path))
    assert rows.count() == 2 and {r.project_key for r in present.collect()} == {"p", "q"}
    later = state.updated(state.load(path), rows.where("name = 'a'"))
    assert later["known_sessions"] == {"p": ["a"], "q": []}
    value = json.loads(open(path).read())
    value["hub_fingerprint"] = "x"
    open(path, "w").write(json.dumps(value))
    with pytest.raises(state.CorruptState):
        state.load(path)


def test_safe_components_are_told_apart():
    names = ["a:b.md", "a?b.md", ".", "..", "", "%", "é" * 100, "é" * 101, "a b", "a%20b"]
    made = [staging.safe_component(n) for n in names]
    assert len(set(made)) == len(names) and all(len(m) <= 200 and "/" not in m for m in made)
    assert staging.fence("x ````` y") == "`" * 6 and staging.fence("") == "````"


def test_prompt_fences_hold(spark):
    rows = [("p", "k", "conflict-content", "local", "a.md", "1" * 64, "x\n````\ny", False), ("p", "k", "conflict-content", "hub", "a.md", None, None, False), ("p", "k", "conflict-content", "marker", "a.md", "2" * 64, None, True)]
    text = staging.prompts(spark.createDataFrame(rows, "project_key string, key string, kind string, label string, filename string, content_hash string, text string, deleted boolean")).first().prompt
    assert "`````md\nx\n````\ny\n`````" in text and "(not readable)" in text and "22222222" in text


def test_locks_and_maps(spark):
    locks = spark.createDataFrame([("a", "h", 1), ("b", "h", 2), ("c", "x", 1), ("d", None, None)], "path string, host string, pid int")
    got = {r.path: r.status for r in diagnose.locks(locks, "h", spark.createDataFrame([(1,)], "pid int")).collect()}
    assert got == {"a": "held", "b": "stale", "c": "foreign", "d": "unparseable"}
    maps = spark.createDataFrame([("1", "EncR"), ("2", "encr"), ("3", "two"), ("4", "new"), ("5", "bad."), ("6", "Shut")], "local_dir string, target string")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {r.local_dir: (r.hub_dir, r.status) for r in diagnose.map_targets(maps, names("EncR", "Two", "TWO"), names("shut"), memory.fold_key).collect()}
    assert got == {"1": ("EncR", "mapped"), "2": ("EncR", "mapped"), "3": (None, "skipped-map-collision"), "4": ("new", "mapped"), "5": (None, "skipped-bad-map"), "6": (None, "skipped-unsafe")}


def test_authorization_has_three_values(spark):
    dirs = spark.createDataFrame([("a", "P", ["/1", "/2"], 3), ("b", "P", ["/1"], 1), ("c", "P", [], 0), ("d", "P", [], 2), ("e", "P", ["/9"], 1), ("f", "P", ["/1", "/2"], 1)], "local_dir string, project_key string, cwds array<string>, n_files int")
    one = lambda rows, s: spark.createDataFrame(rows, s)
    got = outcomes.authorized(dirs, one([("a",)], "local_dir string"), one([("/1", "Q")], "cwd string, bound string"), one([("a", "P"), ("c", "P"), ("d", "P")], "local_dir string, bound string"))
    assert {r.local_dir: r.allowed for r in got.collect()} == {"a": True, "b": False, "c": True, "d": False, "e": None, "f": None}


def test_outcomes_stop_at_what_changed(spark):
    plan = spark.createDataFrame([("p", "a", "copy-to-hub", "local->other"), ("p", "b", "fast-forward", "local->hub"), ("p", "c", "fork", None), ("p", "d", "copy-to-local", "hub->other")], "project_key string, sid string, action string, direction string")
    now = plan.withColumn("action", F.when(F.col("sid") == "d", "suppressed-deleted").otherwise(F.col("action")))
    snap = plan.select("project_key", "sid", F.lit("x").alias("digest"))
    got = {r.sid: r.result for r in outcomes.apply_outcomes(plan, now, snap, snap.where("sid <> 'a'")).collect()}
    assert got == {"a": "skipped-changed", "b": "applied-ff-hub", "c": "reported", "d": "suppressed"}
    flags = outcomes.flags(outcomes.apply_outcomes(plan, now, snap, snap)).first()
    assert flags.wrote_anything and not flags.had_error


def test_command_line(spark, tmp_path, capsys):
    for side in ("local", "hub"):
        (tmp_path / side / "p" / "memory").mkdir(parents=True)
        (tmp_path / side / "p" / "s.jsonl").write_text('{"uuid":"u","type":"user"}\n')
        (tmp_path / side / "p" / "memory" / "a.md").write_text("---\nname: a\n---\nx\n")
    args = ["--local", str(tmp_path / "local"), "--hub", str(tmp_path / "hub")]
    assert cli.main(["status", *args]) == 0 and "p/s: [identical]" in capsys.readouterr().out
    assert cli.main(["memory", *args]) == 0 and "p/a.md: [identical]" in capsys.readouterr().out
    assert cli.main(["doctor", *args]) == 0
    assert cli.main(["status", "--local", "x", "--hub", str(tmp_path / "none")]) == 2
    lost = state.empty() | {"known_sessions": {"p": [str(i) for i in range(9)]}}
    state.save(str(tmp_path / "s.json"), lost)
    assert cli.main(["status", *args, "--state", str(tmp_path / "s.json")]) == 2

import hashlib
import re
import json

import pytest
from pyspark.sql import functions as F

from replicalens.operators import baseline, classify, fuzzy, memory, plan, projects, union
from replicalens.sources import ingest, sinks


def turn(uuid, parent=None, type="user", ts=None, **more):
    return {"uuid": uuid, "parentUuid": parent, "type": type, "timestamp": f"2026-01-01T00:00:{ts or uuid[1:].zfill(2)}.000Z"} | more


def cursor(leaf=None):
    return {"type": "last-prompt"} | ({"leafUuid": leaf} if leaf else {})


U1, U2, U3, U4 = turn("u1"), turn("u2", "u1"), turn("u3", "u2"), turn("u4", "u3")
L = [U1, U2, U3, cursor("u3")]
LONG = [U1, U2, U3, cursor("u3"), U4, turn("u5", "u4"), turn("u6", "u5"), cursor("u6")]
TITLE = {"type": "custom-title", "title": "t"}
FF_HUB, FF_LOCAL = ("fast-forward", "hub->local"), ("fast-forward", "local->hub")
SCENARIOS = [
    (L, L, ("identical", None)),
    (L, [*L, U4, cursor("u4")], FF_HUB),
    ([*L, U4, cursor("u4")], L, FF_LOCAL),
    ([*L, U4, cursor("u4")], [*L, TITLE], ("needs-decision", "local->hub")),
    ([*L, TITLE], [*L, U4, cursor("u4")], FF_HUB),
    (L, [U1, U2, U3, turn("u9", "u2"), cursor("u9")], ("superset-branch", "hub->local")),
    (L, [*L, U4, turn("u5", "u3"), cursor("u4")], ("superset-branch", "hub->local")),
    (L, [*L, U4, cursor("gone")], ("needs-decision", "hub->local")),
    (L, [*L, U4, turn("u5", "u4", toolUseResult=1), cursor("u5")], ("needs-decision", "hub->local")),
    (LONG, [U1, U2, U3, cursor("u3"), U4], FF_LOCAL),
    (LONG, [U1, U2, U3, cursor("u3"), U4, cursor("u3")], ("superset-branch", "local->hub")),
    (LONG, [U1, U2, U3, cursor("u3"), U4, cursor()], ("superset-branch", "local->hub")),
    ([*L, turn("s1", "u2", ts="09", isSidechain=True)], L, FF_LOCAL),
    ([U1, U2, U3, turn("m1", "u3", "mode", "08"), turn("u5", "m1")], [U1, U2, U3], ("needs-decision", "local->hub")),
    ([turn("u1", "u1"), turn("u2", "u1"), cursor("u2")], [turn("u1", "u1")], ("needs-decision", "local->hub")),
    (L, [U1, turn("u2", "u1", note="rewritten"), U3, cursor("u3")], ("damaged", None)),
    ([U1, U2, U3], [U1, U2, U3, U4], FF_HUB),
    (L, [U1, U2, turn("u4", "u2"), cursor("u4")], ("fork", None)),
    (L, [turn("a1"), turn("a2", "a1")], ("identity-collision", None)),
    (L, [*L, turn("x1"), turn("x2", "x1")], ("needs-decision", None)),
    (L, [*L, {"type": "mode"}], ("identical", None)),
    (L, [*L, {"type": "summary", "summary": "s"}], ("superset-branch", "hub->local")),
    (L, [*L, turn("u4", "u3", "system"), cursor("u4")], FF_HUB),
    ([{"type": "summary"}], [{"type": "summary"}], ("needs-decision", None)),
    ([U1, U1, U2], [U1, U1, U2], ("needs-decision", None)),
]


@pytest.fixture(scope="module")
def replica(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("replica")
    for n, sides in enumerate(SCENARIOS):
        for side, rows in zip(("local", "hub"), sides[:2], strict=True):
            folder = root / side / "proj"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"s{n}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (root / "local/proj/zero.jsonl").write_bytes(b"")
    (root / "hub/proj/zero.jsonl").write_text(json.dumps(U1))
    (root / "local/proj/_x.jsonl").write_text("{")
    (root / "hub/proj/_x.jsonl").write_text(json.dumps(U1))
    (root / "local/proj/.hidden.jsonl").write_text("{}")
    tombs = root / "hub/proj/.tombstones"
    tombs.mkdir()
    (tombs / "s0.deleted.json").write_text(json.dumps({"schema_version": 1, "kind": "session", "target": "s0", "base_hash": "0" * 64}))
    (tombs / "bad.deleted.json").write_bytes(b"")
    (tombs / "_coverage.json").write_text(json.dumps({"schema_version": 1, "initialized": True, "epoch": 1}))
    (tombs / "acks.json").write_text(json.dumps({"version": True, "acks": [{"kind": "damaged", "identity": "s", "fingerprint": "f"}]}))
    return {s: str(root / s) for s in ("local", "hub")}


@pytest.fixture(scope="module")
def read(spark, replica):
    files = ingest.read_files(ingest.list_paths(spark, replica, "session")).cache()
    return ingest.session_files(files).cache(), ingest.session_lines(files).cache()


def test_every_listed_file_has_a_row(spark, replica, read):
    files, lines = read
    assert files.count() == 2 * len(SCENARIOS) + 4
    assert {(r.sid, r.state) for r in files.where("sid = 'zero'").collect()} == {("zero", "zero_byte"), ("zero", "ok")}
    assert not lines.where("sid = '_x' AND side = 'local'").first().ok


def test_scenarios_classify_as_they_should_and_mirrored(read):
    files, lines = read
    got = {r.sid: r for r in classify.classify(lines, files).collect()}
    assert got["zero"].klass == got["_x"].klass == "damaged"
    for n, (_, _, want) in enumerate(SCENARIOS):
        assert (got[f"s{n}"].klass, got[f"s{n}"].direction) == want, n
    assert got["s20"].metadata_differs and not got["s0"].metadata_differs
    swap = lambda t: t.withColumn("side", F.when(F.col("side") == "local", "hub").otherwise("local"))
    mirrored = {r.sid: r for r in classify.classify(swap(lines), swap(files)).collect()}
    flip = {"local->hub": "hub->local", "hub->local": "local->hub", None: None}
    for n, (_, _, (klass, way)) in enumerate(SCENARIOS):
        titles = n in (3, 4)  # titles are only guarded on their way to the hub
        assert titles or (mirrored[f"s{n}"].klass, mirrored[f"s{n}"].direction) == (klass, flip[way]), n


def test_union_is_commutative_and_keeps_every_row(read):
    _, lines = read
    swap = lines.withColumn("side", F.when(F.col("side") == "local", "hub").otherwise("local"))
    rows = lambda t: {(r.project_key, r.sid): r.content for r in sinks.jsonl(union.ordered(t)).collect()}
    one = rows(lines.where("sid = 's17'"))
    assert one == rows(swap.where("sid = 's17'"))
    assert [json.loads(x)["uuid"] for x in one["proj", "s17"].splitlines()] in (["u1", "u2", "u3", "u4"], ["u1", "u2", "u4", "u3"])
    got = {r.sid: (r.outcome, r.tip) for r in union.outcomes(lines).collect()}
    assert got["s17"] == ("merged", "u4") and got["s18"][0] == got["s15"][0] == got["s14"][0] == "fallback"
    chosen = lines.sparkSession.createDataFrame([("proj", "s17", "u3"), ("proj", "s1", "u2")], "project_key string, sid string, chosen_tip string")
    got = {r.sid: (r.outcome, r.tip) for r in union.outcomes(lines, chosen).collect()}
    assert got["s17"] == ("merged", "u3") and got["s1"] == ("needs-decision", None)


def test_records_are_strict(spark, replica):
    files = ingest.read_files(ingest.list_paths(spark, replica, "tombstone"))
    assert {(r.target, r.valid) for r in ingest.tombstones(files).collect()} == {("s0", True), ("bad", False)}
    assert ingest.coverage(files).collect()[0].epoch == 1
    assert ingest.acks(files).count() == 0


def test_plan_gives_every_key_one_action(spark, read):
    files, lines = read
    presence = files.select("side", "project_key", F.col("sid").alias("name"), "raw_sha256", (F.col("state") == "ok").alias("usable"))
    presence = presence.unionByName(spark.createDataFrame([("local", "proj", "S1", "x", True)], presence.schema))
    empty = lambda s: spark.createDataFrame([], s)
    tombs = spark.createDataFrame([("proj", "s0", "0" * 64, True), ("proj", "s2", None, False)], "project_key string, target string, base_hash string, valid boolean")
    got = plan.session_plan(presence, classify.classify(lines, files), tombs, empty("project_key string, side string, name string"), empty("project_key string, side string"), empty("project_key string"), empty("project_key string"))
    got = {r.sid: r.action for r in got.collect()}
    assert len(got) == presence.select("name").distinct().count()
    assert got["s0"] == "conflict-delete-vs-update" and got["s2"] == "blocked-tombstone-corrupt"
    assert got["s1"] == got["S1"] == "blocked-casefold-collision" and got["s17"] == "fork"


@pytest.mark.parametrize("known, present, flagged", [(10, 10, False), (10, 2, True), (3, 0, False), (9, 0, True), (8, 4, False)])
def test_disappearance_thresholds(spark, known, present, flagged):
    t = lambda n: spark.createDataFrame([("p", str(i)) for i in range(n)], "project_key string, name string")
    rows = baseline.disappearance(t(known), t(present)).collect()
    assert any(r.flagged for r in rows) == flagged
    lost = baseline.disappearance(t(known), t(present))
    assert [r.code for r in baseline.anomalies(True, "a", "b", lost).collect()] == ["hub-fingerprint-changed"] + ["known-sessions-vanished"] * flagged
    assert [r.code for r in baseline.anomalies(False, None, None, lost).collect()] == ["mount-missing"]


def test_small_projects_are_not_diluted(spark):
    t = lambda n, p: spark.createDataFrame([(p, str(i)) for i in range(n)], "project_key string, name string")
    rows = baseline.disappearance(t(8, "a").union(t(100, "b")), t(100, "b")).collect()
    assert {r.project_key for r in rows if r.flagged} == {"a"}


def test_fuzzy_examples(spark):
    def run(*rows, threshold=0.25):
        e = spark.createDataFrame([("p", i, *r) for i, r in enumerate(rows)], "project_key string, ord int, filename string, name string, description string")
        return fuzzy.candidates(e, threshold).collect()

    one = run(("a.md", "codex-run-stall-handling", "codex hang vs slow resume pkill"), ("b.md", "codex-stall-triage", "codex hang slow 重跑 pkill"))
    assert len(one) == 1 and one[0].shared_name_tokens == "codex,stall"
    assert not run(("a.md", "x", "y"), ("b.md", "z", "w"))
    assert not run(("a.md", "same", "d"), ("b.md", "same", "d"))
    assert not run(("Foo.md", "a-b", "c"), ("foo.md", "a-c", "c"))
    none = run(("a.md", None, "same words"), ("b.md", None, "same words"))
    assert [(r.score, r.name_sim, r.desc_sim) for r in none] == [(0.3, 0.0, 1.0)]
    pair = (("a.md", "a-b", "x"), ("b.md", "a-c", "y"))
    assert not run(*pair) and run(*pair, threshold=0.2)[0].score == 0.2333
    assert len(run(("a.md", "p", "q"), ("b.md", "r", "s"), threshold=0)) == 1
    with pytest.raises(ValueError):
        run(*pair, threshold=float("nan"))


def test_index_statuses(spark):
    docs = spark.createDataFrame([("p", "b.md", "B", " of b\t2 ", "ok"), ("p", "A b.MD", None, None, "ok"), ("q", "x.md", None, None, "zero_byte")], "project_key string, filename string, name string, description string, state string")
    inside = ["- [A b](A%20b.MD)", "- [B](b.md) — of b 2"]
    block = "\n".join([memory.BEGIN, *inside, memory.END])
    indented = f"x\n  {memory.BEGIN}\nown\n  {memory.END}\n"
    texts = [
        ("p", None, "created", f"{memory.HEADING}\n\n{block}\n"), ("p", "own words", "kept-handwritten", "own words"), ("p", indented, "kept-handwritten", indented), ("p", f"x\n{memory.END}\n{memory.BEGIN}", "kept-malformed", f"x\n{memory.END}\n{memory.BEGIN}"),
        ("p", f"x\n{block}\ny", "unchanged", f"x\n{block}\ny"), ("p", f"x\r\n{memory.BEGIN}\n{memory.END}\ny\r\nz", "rebuilt", f"x\r\n{block}\ny\r\nz"), ("p", f"x\n{memory.BEGIN}\r\nold\r\n{memory.END}", "rebuilt", "x\n" + block.replace("\n", "\r\n") + "\r\n"),
        ("q", None, "kept-unreadable", None), ("r", None, "empty", None),
    ]
    for project, text, want, content in texts:
        got = memory.index_plan(docs, spark.createDataFrame([(project, text)], "project_key string, text string")).collect()
        assert (got[0].status, got[0].content) == (want, content)
    told = memory.index_plan(docs, spark.createDataFrame([("p", "[b](b.md) [c](C.md) [m](MEMORY.md)")], "project_key string, text string")).first()
    assert told.missing == ["A b.MD"] and told.stale == ["c.md"]
    links = spark.createDataFrame([("p",)], "project_key string")
    assert memory.index_plan(docs, spark.createDataFrame([("p", block)], "project_key string, text string"), links=links).first().status == "kept-symlink-leaf"


def test_index_digests_equal_the_plan(spark):
    """Streamed line by line, each kind of index gives what the plan with whole contents gives."""
    docs = [(n, d, t, s) for n, d, t, s in (("b.md", "B", " of b\t2 ", "ok"), ("A b.MD", None, None, "ok"))]
    block = "\n".join([memory.BEGIN, "- [A b](A%20b.MD)", "- [B](b.md) — of b 2", memory.END])
    texts = [None, "own words", f"x\n{memory.END}\n{memory.BEGIN}", f"x\n{block}\ny", f"x\r\n{memory.BEGIN}\n{memory.END}\ny\r\nz", f"x\n{memory.BEGIN}\r\nold\r\n{memory.END}", f"```\n{memory.BEGIN}\n```\n[b](b.md) [c](C.md)\n    [d](d.md)"]
    rows = spark.createDataFrame([(f"p{i}", *d) for i in range(len(texts)) for d in docs], "project_key string, filename string, name string, description string, state string")
    rows = rows.union(spark.createDataFrame([("q", "x.md", None, None, "zero_byte")], rows.schema))
    names = [*((f"p{i}", t) for i, t in enumerate(texts)), ("q", None), ("r", None)]
    indexes = spark.createDataFrame(names, "project_key string, text string")
    pieces = [(p, n, "", "", x) for p, t in names if t is not None for n, x in enumerate(re.findall(r"[^\n]*\n|[^\n]+", t))]
    old = spark.createDataFrame(pieces, "project_key string, ord long, fold string, filename string, text string")
    want = {r.project_key: (r.status, r.content and hashlib.sha256(r.content.encode()).hexdigest(), len(r.missing), r.stale) for r in memory.index_plan(rows, indexes).collect()}
    got = {r.project_key: (r.status, r.content_hash, r.missing, r.stale) for r in memory.index_digests(rows, indexes, old).collect()}
    assert got == want


def test_bindings_go_in_order_and_duplicates_block(spark):
    dirs = spark.createDataFrame([("a", ["/x"]), ("b", ["/y"]), ("c", []), ("d", ["/1", "/2"]), ("e", ["/z"]), ("f", ["/w"])], "local_dir string, cwds array<string>")
    pair = lambda rows, k: spark.createDataFrame(rows, f"{k} string, hub_dir string")
    rest = spark.createDataFrame([("e", "match", "H2"), ("f", "ambiguous", None)], "local_dir string, status string, hub_dir string")
    got = projects.bound_first(dirs, pair([("a", "H1")], "local_dir"), pair([("/y", "H2")], "cwd"), pair([("c", "H3")], "local_dir"), rest)
    got = {r.local_dir: (r.status, r.hub_dir) for r in got.collect()}
    assert got == {"a": ("match", "H1"), "b": ("blocked-dup-local", "H2"), "c": ("match", "H3"), "d": ("blocked-multi-cwd", None), "e": ("blocked-dup-local", "H2"), "f": ("ambiguous", None)}


def test_versions_kept_side_by_side(spark):
    new = spark.createDataFrame([("p", "a.md", "1"), ("p", "b.md", "2")], "project_key string, name string, body string")
    old = new.where("name = 'a.md'")
    assert {r.target for r in sinks.keep_both(new, old, ["project_key", "name"], "h", "S").collect()} == {"a.synced-h-S.md", "b.md"}
    assert [r.name for r in sinks.create_only(new, old, ["project_key", "name"]).collect()] == ["b.md"]

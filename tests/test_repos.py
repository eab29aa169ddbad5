import json
import os
import subprocess
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skeinlog import config
from skeinlog.operators import registry
from skeinlog.plans import api
from skeinlog.sources import repos, stores


def run(folder, *args, at=None):
    env = os.environ | {"GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull} | ({"GIT_COMMITTER_DATE": at, "GIT_AUTHOR_DATE": at} if at else {})
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True, env=env)


@pytest.fixture(scope="module")
def checkouts(tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    for name, n, day in (("pond", 3, 10), ("loom", 1, 20)):
        at = root / name
        at.mkdir()
        run(at, "init", "-q", "-b", "trunk")
        for i in range(n):
            (at / f"f{i}.txt").write_text("x")
            (at / "README.md").write_text(f"version {i}")
            run(at, "add", "-A")
            run(at, "commit", "-q", "-m", f"change {i}", at=f"2031-03-{day + i}T12:00:00Z")
    run(root / "pond", "remote", "add", "origin", "git@Example.com:me/pond.git")
    run(root / "pond", "worktree", "add", "-q", str(root / "pond-side"))
    (root / "pond/new1").write_text(""), (root / "pond/f0.txt").write_text("y")
    (root / "bare").mkdir(), run(root / "bare", "init", "-q", "-b", "main")
    return root


def test_collect(spark, checkouts):
    roots = [str(checkouts / x) for x in ("pond", "loom", "bare", "nothing")]
    t = repos.collect(spark, [*roots, roots[0]])
    state = {r["root"]: r for r in t["git"].collect()}
    assert state.keys() == set(roots[:3])
    pond = state[roots[0]]
    assert (pond["branch"], pond["uncommitted"], pond["remote"], pond["subject"], pond["at"]) == ("trunk", 2, "example.com/me/pond", "change 2", datetime(2031, 3, 12, 12))
    assert (state[roots[2]]["branch"], state[roots[2]]["at"]) == ("main", None)
    assert t["commits"].groupBy("root").count().orderBy("count").select("count").collect() == [(1,), (3,)]
    assert sorted(r["file"] for r in t["changes"].filter(F.col("root") == roots[0]).collect()) == ["README.md"] * 3 + ["f0.txt", "f1.txt", "f2.txt"]
    late = repos.collect(spark, roots, since=datetime(2031, 3, 11, tzinfo=timezone.utc))
    assert late["commits"].filter(F.col("root") == roots[0]).count() == 2
    assert [r["root"] for r in repos.by_last_commit(t["git"]).collect()] == [roots[1], roots[0]]
    now = F.lit("2031-04-15 00:00:00").cast("timestamp")
    assert [r["root"] for r in repos.recently_committed(t["git"], now).collect()] == [roots[1]]


def test_tables_feed_the_calls(spark, checkouts):
    t = repos.collect(spark, [str(checkouts / "pond")])
    first = t["commits"].orderBy("at").first()
    cards = spark.createDataFrame([("pond", str(checkouts / "pond"), first["sha"])], "name string, path string, commit string")
    row = registry.drift(cards, t["commits"], t["changes"]).first()
    assert (row["known"], row["commits"], row["changed"]) == (True, 2, ["README.md"])
    since = spark.createDataFrame([(str(checkouts / "pond"), datetime(2031, 3, 10, 12))], "root string, since timestamp")
    assert registry.commits_after(since, t["commits"]).first()["commits"] == 2


def test_resolve(spark, checkouts):
    got = {r["cwd"]: (r["root"], r["known"]) for r in repos.resolve(spark, [f"{checkouts}/pond-side", f"{checkouts}/pond/", f"{checkouts}/./none"]).collect()}
    pond = os.path.realpath(f"{checkouts}/pond")
    assert {os.path.realpath(got[f"{checkouts}/{x}"][0]) for x in ("pond-side", "pond/")} == {pond}
    assert got[f"{checkouts}/./none"] == (f"{checkouts}/none", False)


def test_aliases(spark, checkouts):
    from skeinlog.operators import select
    from skeinlog.sources import transcripts

    link = checkouts / "link"
    link.symlink_to(checkouts / "pond")
    real = os.path.realpath(checkouts / "pond")
    repos_ = repos.aliases(spark, [str(link), str(checkouts / "loom")])
    cwds = [("a", f"{link}/x"), ("b", f"{real}/y/z"), ("c", f"{real}-side"), ("d", real)]
    got = select.in_repos(spark.createDataFrame(cwds, "id string, cwd string"), repos_)
    assert sorted((r["id"], r["root"]) for r in got.collect()) == [(x, str(link)) for x in "abd"]
    (checkouts / "t" / transcripts.project_slug(real)).mkdir(parents=True)
    assert len(transcripts.places(spark, str(checkouts / "t"), "blocks", [str(link)])) == 1


def test_settings_file(tmp_path):
    path = tmp_path / "conf/settings.toml"
    assert config.Settings.load(path) == config.Settings() and path.exists()
    path.write_text('# mine\nstale_days = 7 # soon\ndev_roots = [\n  "/old",\n] # here\nunknown = 1\n\n[sources.x]\ndialect = "blocks"\nfolder = "~/x"\ndev_roots = ["not this"]\n')
    s = config.Settings.load(path)
    assert (s.stale_days, s.dev_roots, s.sources) == (7, ["/old"], {"x": ("blocks", os.path.expanduser("~/x"))})
    config.set_dev_roots(path, ["/a b", 'q"'])
    assert config.Settings.load(path).dev_roots == ["/a b", 'q"']
    text = path.read_text()
    assert all(x in text for x in ("# mine", "stale_days = 7 # soon", "unknown = 1", 'dev_roots = ["not this"]')) and "/old" not in text
    fresh = tmp_path / "new.toml"
    config.set_dev_roots(fresh, ["/a"])
    assert config.Settings.load(fresh).dev_roots == ["/a"] and fresh.read_text().startswith("# Settings")


def test_profile_index_and_json(spark, tmp_path):
    text, made = stores.load_profile(tmp_path / "me/profile.md")
    assert made and stores.load_profile(tmp_path / "me/profile.md") == (text, False)
    reg = spark.createDataFrame([(0, "/r/pond", "", "pond", datetime(2031, 1, 1))], "position int, path string, remote string, name string, last_seen timestamp")
    cards = spark.createDataFrame([("pond", "Holds water.", "", None)], "name string, summary string, status string, updated timestamp")
    stores.write_index(api.index(reg, cards), tmp_path / "index.md")
    assert (tmp_path / "index.md").read_text() == "# Projects\n- [[pond]] — Holds water. · /r/pond\n"
    (only,) = stores.print_json(reg.select("name", F.lit(None).cast("string").alias("none")))
    assert json.loads(only) == {"name": "pond", "none": None} and "\n" in only
    check = api.card_check(cards, reg).first()
    assert (check["ok"], check["message"]) == (True, "1 of 1 projects have a card")


def test_no_handoffs(spark):
    notes = spark.createDataFrame([("n1", "-r-pond", "", "a", datetime(2031, 1, 1), "b"), ("n2", "-r-loom", "/r/loom", "a", datetime(2031, 1, 2), "b")], "note_id string, key string, root string, agent string, at timestamp, body string")
    reg = spark.createDataFrame([(0, "/r/pond", "pond two")], "position int, path string, name string")
    text = api.no_handoffs(notes, reg, "lom").first()["text"]
    assert text.startswith('no handoff notes for "lom". Projects with notes: loom, pond two. Did you mean: loom')
    assert api.no_handoffs(notes.limit(0), reg, "x").first()["text"] == "no handoff notes yet"


def test_upsert_by_path_then_remote(spark):
    t = [datetime(2031, 1, 1) + timedelta(days=i) for i in range(5)]
    entry = "position int, path string, remote string, name string, last_seen timestamp"
    old = spark.createDataFrame([(0, "/a", "h/a", "a", t[1]), (1, "/b", "h/b", "b", t[1]), (2, "/b2", "h/b", "b2", t[1])], entry)
    seen = spark.createDataFrame([("/a", "", "x", t[0]), ("/moved", "h/b", "y", t[2]), ("/new", "h/new", "new", t[3]), ("/new", "h/newer", "new", t[4])], "path string, remote string, name string, last_seen timestamp")
    got = {r["path"]: (r["remote"], r["name"], r["last_seen"]) for r in registry.upsert(old, seen).collect()}
    assert got == {"/a": ("h/a", "a", t[1]), "/moved": ("h/b", "b", t[2]), "/b2": ("h/b", "b2", t[1]), "/new": ("h/newer", "new", t[4])}


def test_too_many_queries(spark):
    names = spark.createDataFrame([("a", 0)], "name string, position int")
    with pytest.raises(ValueError):
        registry.closest(names, spark.range(registry.MAX_QUERIES + 1).select(F.col("id").cast("string").alias("query")))

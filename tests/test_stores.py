import os
import threading
import time
from datetime import datetime, timezone

import pytest

from skeinlog import config
from skeinlog.operators import cards, registry
from skeinlog.sources import stores

T0 = datetime(2026, 11, 1, 12, tzinfo=timezone.utc)


def test_settings():
    assert config.Settings(disabled_repos=["~/x"]).disabled_repos == [os.path.expanduser("~/x")]
    for bad in ({"stale_days": -1}, {"sources": {"a": ("other", "/x")}}):
        with pytest.raises(ValueError):
            config.Settings(**bad)


def test_notes_of_one_second(tmp_path):
    paths = [stores.write_note(tmp_path, "/repo/x", "agent b!", f"n{i}", T0) for i in range(3)]
    assert [p.name for p in paths] == [f"2026-11-01T12-00-0{i}Z-agent-b-.md" for i in range(3)]
    assert (tmp_path / "-repo-x/.root").read_text() == "/repo/x"


def test_registry_in_parallel(tmp_path):
    path = tmp_path / "registry.json"
    work = [threading.Thread(target=stores.update_registry, args=(path, lambda old, i=i: registry.fold(old, [registry.Entry(f"/r/p{i}", last_seen=T0)]), 20)) for i in range(8)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert {e.path for e in stores.load_registry(path)} == {f"/r/p{i}" for i in range(8)}
    assert stores.load_registry(path)[0].last_seen == T0


def test_registry_faults(tmp_path):
    path = tmp_path / "registry.json"
    path.write_text("{broken")
    assert stores.update_registry(path, lambda old: old) == []
    assert (tmp_path / "registry.json.bak").read_text() == "{broken"
    lock = tmp_path / ".registry.json.lock"
    lock.touch()
    with pytest.raises(TimeoutError):
        stores.update_registry(path, lambda old: old, timeout=0.05)
    os.utime(lock, (time.time() - 60,) * 2)
    assert stores.update_registry(path, lambda old: old, timeout=0.05) == [] and not lock.exists()


def test_cards(spark, tmp_path):
    (tmp_path / "b.md").write_text("broken by hand")
    made = cards.parse_cards(spark.createDataFrame([("a.md", "---\nname: a\n---\nOne."), ("b.md", "---\nname: b\n---\nTwo.")], "path string, value string"))
    assert stores.save_cards(made, tmp_path) == 2
    assert (tmp_path / "a.md").read_text() == "---\nname: a\n---\nOne.\n" and (tmp_path / "b.md.bak").read_text() == "broken by hand"
    assert not (tmp_path / "a.md.bak").exists()


def test_find_repos(tmp_path):
    for p in ("a/.git", "a/inner/.git", "b/c/.git", "node_modules/x/.git", ".hidden/y/.git", "1/2/3/4/5/.git"):
        (tmp_path / p).mkdir(parents=True)
    assert stores.find_repos([tmp_path]) == [str(tmp_path / "a"), str(tmp_path / "b/c")]

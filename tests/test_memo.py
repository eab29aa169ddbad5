import os
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from test_transcripts import lines, says  # noqa: E402

from skeinlog.functions.text import fold_case  # noqa: E402
from skeinlog.operators import registry  # noqa: E402
from skeinlog.plans import api, memo  # noqa: E402


def test_calls_share_a_scan_until_its_time_is_over_and_files_changed(spark, tmp_path):
    (tmp_path / "p").mkdir()
    f = tmp_path / "p/s.jsonl"
    f.write_text(lines([says("one")]))
    now = [0.0]
    scans = memo.SessionScans(spark, ttl=45, clock=lambda: now[0])
    load = lambda: [r["last_prompt"] for r in scans.load({"a": ("blocks", str(tmp_path))}).collect()]
    assert load() == ["one"] and (scans.listings, scans.scans) == (1, 1)
    f.write_text(lines([says("one"), says("two")]))
    now[0] = 44.9
    assert load() == ["one"] and (scans.listings, scans.scans) == (1, 1)
    plan = scans.load({"a": ("blocks", str(tmp_path))})._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "parse_json" not in plan and "text" not in plan.split("Location")[0]
    now[0] = 45.0
    assert load() == ["two"] and (scans.listings, scans.scans) == (2, 2)
    now[0] = 95.0
    assert load() == ["two"] and (scans.listings, scans.scans) == (3, 2)  # nothing changed: listed, not parsed
    now[0] = 120.0
    assert load() == ["two"] and (scans.listings, scans.scans) == (3, 2)
    assert [r["first_prompt"] for r in scans.load({"a": ("blocks", str(tmp_path))}, tail=True).collect()] == ["one"] and scans.scans == 3


def test_case_folding_of_all_code_points(spark):
    """Two characters fold to one if steps of single-character upper, lower and title case lead from one to the other;
    dotted and dotless i, whose cases are those of other letters in some languages only, are left alone."""
    root = {}

    def find(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    every = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    for c in every:
        if c not in "İı":
            for to in (c.upper(), c.lower(), c.title()):
                if len(to) == 1 and find(to) != find(c):
                    root[find(c)] = find(to)
    df = spark.createDataFrame(pa.table({"c": every}))
    got = {r["c"]: r["f"] for r in df.select("c", fold_case(F.col("c")).alias("f")).filter("c <> f").collect()}
    for c in every:
        assert (got.get(c, c) == got.get(find(c), find(c))), (c, unicodedata.name(c, ""))
    classes = {}
    for c in every:
        classes.setdefault(got.get(c, c), set()).add(find(c))
    assert all(len(x) == 1 for x in classes.values())


def test_names_and_sections_in_any_case(spark):
    reg = spark.createDataFrame([("/p/1", "ΟΔΟΣ", 1), ("/p/2", "ſervice", 2), ("/p/3", "Straße", 3)], "path string, name string, position int")
    assert [registry.find(reg, q).first()["path"] for q in ("οδος", "οδοσ", "SERVICE", "STRAẞE")] == ["/p/1", "/p/1", "/p/2", "/p/3"]
    assert registry.find(reg, "strasse").first() is None
    text = spark.range(1).select(api.update_profile(F.lit("## Kelvin\n- a\n"), "kelvin", "b").alias("t")).first()["t"]
    assert text == "## Kelvin\n- a\n- b\n"

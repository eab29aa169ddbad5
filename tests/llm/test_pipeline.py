import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skeinlog.llm import common, mixing, sentencepiece_codec


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = common.documents(spark, folder)
    sp = sentencepiece_codec.load(sentencepiece_codec.model_path())
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.store(stage(spark, docs, folder))
        if stage is not corpus_pipeline.encoding_stage:
            assert docs.columns == before.columns
        seen[name] = docs.collect()
        assert seen[name]
    first, lines, joined, mixed, coded = (seen[n] for n, _ in corpus_pipeline.STAGES)
    assert all(re.search(r"[^\W\d_]", r["text"] or "") for r in first)
    assert len(lines) == len(first) and all(r["n_chars"] == len(r["text"]) for r in lines)
    assert len(joined) < len(lines)
    assert {(r["doc_id"], r["text"]) for r in mixed} <= {(r["doc_id"], r["text"]) for r in joined}
    want = sorted(((r["doc_id"], sp.encode(r["text"])) for r in mixed), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in coded), key=repr) == want


def brute_lines(rows):
    """Texts after line dedup: keys of 20 code points in three documents stay in the largest doc_id only."""
    space, lower = " \t\n\x0b\x0c\r", str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    key = lambda line: line.strip(space).translate(lower)
    holders = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= 20 and r["doc_id"] is not None:
                holders.setdefault(key(line), set()).add(r["doc_id"])
    gone = {k: max(h) for k, h in holders.items() if len(h) >= 3}
    return ["\n".join(x for x in (r["text"] or "").split("\n") if key(x) not in gone or r["doc_id"] == gone[key(x)]) for r in rows]


def brute_groups(rows):
    """Index of the first member of each row's group, for five-word shingles at 0.8; None for rows without words."""
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = [i if s else None for i, s in enumerate(sets)]
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def test_each_stage_on_rows_with_clashing_columns(spark, docs):
    """Nulls, repeated rows and ids, and columns named like the operators' own go through every stage."""
    rows = docs.collect()
    out = corpus_pipeline.language_stage(spark, docs, "")
    assert out.columns == docs.columns
    letters = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(map(repr, out.collect())) == sorted(map(repr, letters))

    out = corpus_pipeline.line_stage(spark, docs, "")
    assert out.columns == docs.columns
    want = [repr(r[:1] + (t,) + r[2:4] + (len(t),) + r[5:]) for r, t in zip(map(tuple, rows), brute_lines(rows))]
    assert sorted(repr(tuple(r)) for r in out.collect()) == sorted(want)

    out = corpus_pipeline.join_stage(spark, docs, "")
    assert out.columns == docs.columns
    kept, root = out.collect(), brute_groups(rows)
    least = {}
    for r, g in zip(rows, root):
        if g is not None and r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    blank = lambda r: not re.search(r"[^\x20\x09-\x0D]", r["text"] or "")
    assert sorted(r["doc_id"] for r in kept if not blank(r)) == sorted(least.values())
    assert sorted(repr(r) for r in kept if blank(r)) == sorted(repr(r) for r in rows if blank(r))

    out = corpus_pipeline.mixing_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = Counter()
    key = {}
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["row_key"]] += r["copies"]
    for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect():
        key[r["doc_id"], r["text"]] = (r["doc_id"], r["k"])
    assert Counter({key[k]: n for k, n in got.items()}) == +want

    coded = corpus_pipeline.encoding_stage(spark, docs, "")
    sp = sentencepiece_codec.load(sentencepiece_codec.model_path())
    want = sorted(((r["doc_id"], sp.encode(r["text"] or "")) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in coded.collect()), key=repr) == want


def test_empty_table(spark, tmp_path, no_docs):
    no_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_python_gets_small_batches_whatever_the_session_allows(spark, docs):
    """What comes from Python is stored with the library's own limits when a stage returns."""
    for stage in (corpus_pipeline.language_stage, corpus_pipeline.encoding_stage):
        assert "MapInArrow" not in stage(spark, docs, "")._jdf.queryExecution().toString()

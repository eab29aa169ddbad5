import random
import unicodedata
import zlib
from collections import Counter

import numpy as np

from skeinlog.llm import language_id as m


def brute_trigrams(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c).startswith("L"):
            word += c
        elif word:
            w = "\0" + word + "\0"
            out += [w[i : i + 3] for i in range(len(w) - 2)]
            word = ""
    return out


def test_trigrams(texts):
    letters = m.letter_table()
    for t in [*texts, "ÀB1c—d_E", "a"]:
        got = ["".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0)) for g in m.trigrams(t, letters)]
        assert got == brute_trigrams(t)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    rng = np.random.default_rng(0)
    names = [f"l{i:02}" for i in range(70)]  # more languages and levels than bits of a word
    grams = [np.unique(rng.integers(0, 1 << 60, 300)) for _ in names]
    n = [1 + (rng.random(len(g)) < 0.1) * 500_000 + (rng.random(len(g)) < 0.1) * 40 for g in grams]
    rows = [(k, int(g), int(c)) for k, gs, cs in zip(names, grams, n) for g, c in zip(gs, cs)]
    totals = [(k, i, int(cs.sum())) for i, (k, cs) in enumerate(zip(names, n))]
    size = 1 << 13
    slots = m.build_filter(spark.createDataFrame(rows, "lang string, gram bigint, n bigint"), spark.createDataFrame(totals, "lang string, k int, total bigint"), len(names), size)
    f = m.Filter.of(names, slots)
    other = rng.integers(0, 1 << 60, 20_000).astype(np.uint64)
    own_masks = [f.masks(g.astype(np.uint64)) for g in grams]
    other_masks = f.masks(other)
    for i, (g, c) in enumerate(zip(grams, n)):
        for level, least in enumerate(m.LEVELS):
            got, want = m.bits(own_masks[i], i, level).astype(bool), c / c.sum() >= least
            assert got[want].all() and np.mean(got[~want]) <= 0.2 if (~want).any() else got.all()
            assert abs(m.bits(other_masks, i, level).mean() - f.wrong[i, level]) < 0.01


def plain_scores(learned, text):
    """The score of each language without any filter: sets of trigrams for each level."""
    grams, out = brute_trigrams(text), {}
    for lang, counts in learned.items():
        total = sum(counts.values())
        hits = [sum(counts[g] > 0 and counts[g] / total >= least for g in grams) / len(grams) for least in m.LEVELS] if grams else [0]
        out[lang] = sum(hits) / len(m.LEVELS)
    return out


def test_equals_a_plain_version(spark, docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    learned = {}
    for _, text, lang in rows:
        if lang is not None:
            learned.setdefault(lang, Counter()).update(brute_trigrams(text))
    model = m.learn(docs)
    assert model.langs == sorted(learned)
    by_text = {}
    for r in m.identify(docs, model, keep=("doc_id", "text")).collect():
        by_text[r["text"]] = r
    for text, r in by_text.items():
        want = plain_scores(learned, text)
        if r["lang_pred"] == "und":
            assert not brute_trigrams(text)
        else:
            assert abs(r["score"] - want[r["lang_pred"]]) < 0.03
            assert want[r["lang_pred"]] >= max(want.values()) - 0.03


def test_a_small_filter_is_corrected_for(spark):
    """With far too few slots predictions still hold, since false positives are allowed for."""
    rng = random.Random(4)
    langs = {"aa": ("ka", "to", "mi", "ne", "vo"), "bb": ("schl", "ung", "ein", "gat")}
    rows = [(i, sentences(rng, langs["aa" if i % 2 else "bb"], 200), "aa" if i % 2 else "bb") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = m.learn(df.filter("doc_id < 30"), filter_bytes=512)
    assert model.slots.nbytes <= 512 and model.wrong[:, 0].max() > 0.01
    assert all(r["lang_pred"] == r["lang"] for r in m.identify(df, model, keep=("doc_id", "lang")).collect())


def test_query(spark, docs, sf_dir):
    out = m.op9_language_id(spark, sf_dir)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def sentences(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out(spark):
    rng = random.Random(4)
    langs = {"aa": ("ka", "to", "mi", "ne"), "bb": ("schl", "ung", "ein", "ö"), "cc": ("que", "ção", "es", "ta")}
    rows = [(i, sentences(rng, langs[k], 60), k if i % 5 else None) for i, k in enumerate(rng.choices(sorted(langs), k=300))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = m.learn(df.filter("doc_id % 3 = 0"))
    got = {r["doc_id"]: r for r in m.identify(df, model).collect()}
    held = [r for r in rows if r[0] % 3 and r[2]]
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_und(docs, no_docs):
    model = m.learn(docs)
    rows = m.identify(docs, model, keep=("doc_id", "text")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["lang_pred"] == "und") == (not brute_trigrams(r["text"]))
        assert r["lang_pred"] in ("en", "fr", "und")
    assert {(r["lang_pred"], r["score"]) for r in m.identify(docs, m.learn(no_docs)).collect()} == {("und", 0.0)}
    assert m.identify(no_docs, model).collect() == []

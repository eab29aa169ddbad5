import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinlog.llm import bradley_terry, text_stats, weak_rules


def brute_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_stats_of_texts(texts):
    for t in texts:
        assert text_stats.stats((t or "").encode())[:5] == brute_stats(t or "")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t\x0b\x1c #|", max_size=80))
def test_stats_of_any_text(text):
    assert text_stats.stats(text.encode())[:5] == brute_stats(text)


def test_repeated_words_with_many_kinds():
    ids = np.concatenate([np.arange(9000), np.arange(100, 107)])
    assert text_stats.repeated_words(ids, 9000) == 14


def test_judge(docs):
    rows = weak_rules.judge(docs).collect()
    assert sorted(((r["doc_id"], r["n_words"]) for r in rows), key=repr) == sorted(((r["doc_id"], brute_stats(r["text"] or "")[0]) for r in docs.collect()), key=repr)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["good"] >= 0.5)


def plain_em(votes):
    """Expectation-maximisation document by document, for the same start and bounds."""
    n, k = len(votes), len(votes[0])
    bad, caught, blamed = 0.1, [0.3] * k, [0.01] * k
    for _ in range(1000):
        p_bad = []
        for v in votes:
            b, g = bad, 1 - bad
            for i, x in enumerate(v):
                if x:
                    b *= caught[i] if x < 0 else 1 - caught[i]
                    g *= blamed[i] if x < 0 else 1 - blamed[i]
            p_bad.append(b / (b + g))
        new = []
        for weight, start, low, high in ((p_bad, 0.3, 0.001, 0.999), ([1 - p for p in p_bad], 0.01, 1e-5, 0.05)):
            row = []
            for i in range(k):
                hits = sum(w for w, v in zip(weight, votes) if v[i] < 0) + 20 * start
                row.append(min(high, max(low, hits / (sum(w for w, v in zip(weight, votes) if v[i]) + 20))))
            new.append(row)
        bad_new = (sum(p_bad) + 1) / (n + 10)
        moved = max(abs(bad_new - bad), *(abs(a - b) for x, y in zip(new, (caught, blamed)) for a, b in zip(x, y)))
        bad, (caught, blamed) = bad_new, new
        if moved < 1e-9:
            break
    return [1 - p for p in p_bad]


def test_verdict_is_that_of_a_plain_em(docs):
    rows = weak_rules.judge(docs).collect()
    names = [c for c in rows[0].asDict() if c.startswith("vote_")]
    want = plain_em([[r[c] for c in names] for r in rows])
    # the last round's accuracies give the posterior; at rest one round more or less changes nothing
    assert np.abs(np.array([r["good"] for r in rows]) - want).max() < 1e-5


def prose(rng, n, words=400):
    out = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(words):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(n)]
    return " ".join(w.capitalize() + ("." if i % 9 == 8 else "") if i % 9 in (0, 8) else w for i, w in enumerate(out))


def test_votes_are_weighed_not_all_must_pass(spark):
    rng = random.Random(3)
    rows = [prose(rng, rng.randint(60, 200)) for _ in range(300)]
    rows += [" ".join(w + "!!" for w in prose(rng, 80).upper().split()) for _ in range(25)]
    rows += [" ".join(w + "###" for w in prose(rng, 80).split()) for _ in range(25)]
    outvoted = len(rows)
    rows += [prose(rng, 15) for _ in range(12)]  # short, else good
    got = {r["doc_id"]: r for r in weak_rules.judge(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    names = [c for c in got[0].asDict() if c.startswith("vote_")]
    with_bad = lambda i: [c for c in names if got[i][c] < 0]
    assert all(got[i]["kept"] for i in range(300)) and not any(got[i]["kept"] for i in range(300, 350))
    assert all(with_bad(i) and got[i]["kept"] for i in range(outvoted, outvoted + 12))


def test_faint_signs_add_up():
    """One vote of a rule that often blames good documents isn't decisive; three such votes are."""
    pattern = np.array([[1, 1, 1, 1], [-1, 1, 1, 1], [1, -1, 1, 1], [1, 1, -1, 1], [-1, -1, -1, 1]])
    model = weak_rules.fit(pattern, np.array([900.0, 20, 20, 20, 40]))
    assert (model.posterior(pattern) >= 0.5).tolist() == [True, True, True, True, False]


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    bad = rng.random(40_000) < 0.2
    caught, blamed, active = np.array([0.6, 0.5, 0.7, 0.8, 0.4]), np.array([0.01, 0.02, 0.005, 0.03, 0.02]), np.array([0.9, 0.8, 0.9, 0.7, 0.8])
    says_bad = rng.random((40_000, 5)) < np.where(bad[:, None], caught, blamed)
    vote = np.where(says_bad, -1, 1) * (rng.random((40_000, 5)) < active)
    pattern, counts = np.unique(vote, axis=0, return_counts=True)
    model = weak_rules.fit(pattern, counts.astype(float))
    assert abs(model.bad - 0.2) < 0.03 and np.abs(model.caught - caught).max() < 0.06 and np.abs(model.blamed - blamed).max() < 0.02


def test_fit_of_nothing():
    assert weak_rules.fit(np.zeros((0, 4), np.int64), np.zeros(0)).bad == 0.1


def test_weak_rules_query(spark, docs, sf_dir):
    out = weak_rules.op3_weak_rules(spark, sf_dir)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = [(r["doc_id"], *brute_stats(r["text"] or "")) for r in docs.collect()]
    assert sorted(map(repr, (tuple(r)[:6] for r in out.collect()))) == sorted(map(repr, want))


def test_content(texts):
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or ""))
        got = text_stats.content((t or "").encode(), 16)
        want = Counter(zlib.crc32(x.encode().lower()) % 16 for x in w)
        assert np.allclose(got, [want[i] / max(len(w), 1) for i in range(16)], atol=1e-6)


def test_fit_minimises_the_pairs_loss():
    """Plain gradient descent on all pairs drawn ends at the same weights."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    good = x @ [1.0, -2.0, 0.5] + rng.normal(size=60) > -1
    model = bradley_terry.fit(x, good, opponents=7, ridge=0.01)
    z = (x - model.center) / model.scale
    up, down = z[good], z[~good]
    k, draw = 7 * min(len(up), len(down)), np.random.default_rng(0)
    at = [np.arange(k) % len(s) if len(s) == min(len(up), len(down)) else draw.integers(0, len(s), k) for s in (up, down)]
    pairs, w = list(zip(up[at[0]], down[at[1]])), np.zeros(3)
    for _ in range(4000):
        slope = sum(-(u - d) / (1 + np.exp((u - d) @ w)) for u, d in pairs) / k + 0.01 * w
        w = w - 0.5 * slope
    assert np.abs(w - model.weights).max() < 1e-3
    assert abs(np.mean(z @ model.weights < model.threshold) - np.mean(~good)) <= 1 / 60


def test_ranking_equals_a_plain_one(spark, docs, texts):
    """rank() against features of each text in plain Python, fitted on what the labels meet, one score at a time."""
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, len(texts), 2) if i != 20] + [(None, 1), (9999, 0), (3, 7)], "doc_id bigint, quality int")
    x, good = bradley_terry.drawn(bradley_terry.featured(docs, buckets=8), labels, "doc_id", "quality", 1000)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((*np.round(plain_features(t or "", 8), 5), known[i]) for i, t in rows if i is not None and known.get(i) in (0, 1))
    assert np.allclose(sorted((*np.round(a, 5), int(b)) for a, b in zip(x, good)), want, atol=1e-4)
    model = bradley_terry.fit(x, good)
    got = sorted(((r["doc_id"], r["score"]) for r in bradley_terry.rank(docs, labels, buckets=8).collect()), key=repr)
    plain = [1 / (1 + np.exp(-np.clip(sum((f - m) / s * w for f, m, s, w in zip(plain_features(t or "", 8), model.center, model.scale, model.weights)) - model.threshold, -500, 500))) for _, t in rows]
    want = sorted(zip((i for i, _ in rows), plain), key=repr)
    assert np.allclose(sorted(s for _, s in got), sorted(s for _, s in want), atol=1e-4)
    mine, theirs = ({i: s for i, s in z if i not in (20, None)} for z in (got, want))
    assert mine.keys() == theirs.keys() and all(abs(mine[i] - theirs[i]) < 1e-4 for i in mine)


def test_sample_is_bounded(spark, docs, texts):
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))] * 3, "doc_id bigint, quality int")
    x, good = bradley_terry.drawn(bradley_terry.featured(docs, buckets=8), labels, "doc_id", "quality", 40)
    assert 20 <= len(x) == len(good) <= 40


def plain_features(text, buckets):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, same, repeats = brute_stats(text)
    count = lambda pattern: len(re.findall(pattern, text))
    share = lambda a, b, most=1.0: min(a / b if b else 0.0, most)
    upper, lower, wide = count("[A-Z]"), count("[a-z]"), count(r"[^\x00-\x7F]")
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    ratios = [
        share(symbols, n), share(upper + lower + wide, chars), share(upper, upper + lower), share(count("!"), n), share(count(r"\|"), n), share(count("[0-9]"), chars),
        share(len(set(w)), (n * min(n, 400)) ** 0.5, 1.2), share(sum(a == b for a, b in zip(w, w[1:])), n), share(repeats, n), share(same, len(lines)),
        share(count("[.!?]"), n, 0.5), share(chars, n, 12.0), min(np.log1p(n) / 10, 1.0), float(n == 0),
    ]
    seen = Counter(zlib.crc32(x.encode().lower()) % buckets for x in w)
    return ratios + [seen[i] / max(n, 1) for i in range(buckets)]


def test_features_equal_plain_ones(docs):
    for r in bradley_terry.featured(docs.select("doc_id", "text"), buckets=8).join(docs.select("doc_id", "text").distinct(), "doc_id").filter("doc_id <> 20").collect():
        assert np.allclose(r["x"], plain_features(r["text"] or "", 8), atol=1e-6)


def test_ranking_learns(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = [rng.choice(("lorem", "ipsum", "dolor", "sit")) + ("###" if bad else "") for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None), (1001, ""), (None, "# # #")]
    labels += [(None, 1, 0), (5000, 1, 0), (3, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame([x for x in labels if x[0] is None or x[0] % 2], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in bradley_terry.rank(docs, known).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 5 != 0) for i in range(0, 600, 2)]) > 0.98


def test_ranking_without_labels(docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in bradley_terry.rank(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(5, 1), (8, 1)], "doc_id bigint, quality int")
    assert all(r["score"] > 0.99 for r in bradley_terry.rank(docs, one).collect())
    assert bradley_terry.rank(no_docs, one).collect() == []


def test_judge_of_an_empty_table(no_docs):
    assert weak_rules.judge(no_docs).collect() == []


def plain_votes(text):
    """The votes on a text, counted by hand from the text itself."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    chars = "".join(words)
    count = lambda kinds: sum(c in kinds for c in text or "")
    upper, lower = sum("A" <= c <= "Z" for c in chars), sum("a" <= c <= "z" for c in chars)
    letters = upper + lower + sum("0" <= c <= "9" for c in chars) + sum(ord(c) > 127 for c in chars)
    lines = [x for x in (text or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    windows = {}
    for i in range(n - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}

    def vote(part, of, good, bad, asked=True):
        if n < 10 or not asked or not of:
            return 0
        ratio = part / of
        return -1 if bad(ratio) else 1 if good(ratio) else 0

    return {
        "symbols": vote(count("#*$%&|<>"), n, lambda r: r < 0.02, lambda r: r > 0.1),
        "pipes": vote(count("|"), n, lambda r: r < 0.005, lambda r: r > 0.05),
        "letters": vote(letters, len(chars), lambda r: r > 0.95, lambda r: r < 0.9),
        "upper": vote(upper, upper + lower, lambda r: 0.005 < r < 0.12, lambda r: r > 0.25),
        "bangs": vote(count("!"), n, lambda r: r < 0.02, lambda r: r > 0.2),
        "stutter": vote(sum(a == b for a, b in zip(words, words[1:])), n, lambda r: r < 0.03, lambda r: r > 0.08),
        "distinct": vote(len(set(words)), (n * min(n, 400)) ** 0.5, lambda r: r > 0.6, lambda r: r < 0.4, n >= 50),
        "repeats": vote(len(repeated), n, lambda r: r < 0.05, lambda r: r > 0.1),
        "lines": vote(len(lines) - len(set(lines)), len(lines), lambda r: r < 0.1, lambda r: r > 0.4, len(lines) >= 3),
        "stops": vote(count(".!?"), n, lambda r: 0.03 < r < 0.5, lambda r: r < 0.01 or r >= 0.5),
        "length": vote(len(chars), n, lambda r: 3 < r < 8, lambda r: r > 10 or r < 2),
        "short": vote(n, 1, lambda r: r >= 40, lambda r: r < 20),
    }


def test_votes_are_those_counted_by_hand(spark, texts):
    rng = random.Random(6)
    some = list(texts)
    for share in (0, 0.005, 0.01, 0.015, 0.03, 0.06, 0.09, 0.15, 0.3, 0.45, 0.7):
        for change in (lambda w, p: w + "#", lambda w, p: w + "|", lambda w, p: w.upper(), lambda w, p: w + "!", lambda w, p: p, lambda w, p: w + ".", lambda w, p: w * 4, lambda w, p: w[:1], lambda w, p: "same", lambda w, p: w + "\nagain and again\n"):
            n, out = rng.choice([12, 30, 60, 200]), []
            for w in (f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.choice('xyz')}" for _ in range(n)):
                out.append(change(w, out[-1] if out else w) if rng.random() < share else w)
            some.append(" ".join(out))
    got = {r["doc_id"]: r for r in weak_rules.judge(spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string")).collect()}
    seen = {}
    for i, text in enumerate(some):
        for rule, vote in plain_votes(text).items():
            assert got[i][f"vote_{rule}"] == vote, (rule, text)
            seen.setdefault(rule, set()).add(vote)
    assert all(v == {-1, 0, 1} for v in seen.values()), seen


def test_every_labelled_document_counts(spark):
    """Fitted in blocks by Spark: gradient descent on all pairs within the blocks ends at the same model, whatever label is
    rare, and no labelled row is left out."""
    rng = np.random.default_rng(3)
    for n_bad, block in ((150, 100), (9, 50), (291, 60)):
        x = rng.normal(size=(300, 3))
        good = np.argsort(np.argsort(x @ [1.0, -2.0, 0.5] + rng.normal(size=300))) >= n_bad
        draw = np.arange(300) * 7919 % 1009
        got = spark.createDataFrame([(bool(g), [float(v) for v in r], int(d)) for g, r, d in zip(good, x, draw)], "good boolean, x array<double>, draw bigint").repartition(5)
        model = bradley_terry.fit_blocks(got, 300, int(good.sum()), block, ridge=0.01)
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        rare = min(n_bad, 300 - n_bad)
        all_over = rare < 16 * (300 // block) and rare <= block
        blocks = 300 // block if all_over else min(300 // block, rare // 16)
        meets = lambda i, j: all_over or draw[i] % blocks == draw[j] % blocks
        d = np.array([z[i] - z[j] for i in np.flatnonzero(good) for j in np.flatnonzero(~good) if meets(i, j)])
        assert not all_over or len(d) == n_bad * (300 - n_bad)
        w = np.zeros(3)
        for _ in range(2000):
            w = w - 0.5 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 0.01 * w)
        assert np.abs(w - model.weights).max() < 1e-3
        assert abs(model.threshold - np.quantile(z @ model.weights, 1 - good.mean())) < 1e-9


def test_order_statistics(spark):
    values = [0.0] * 50 + [1e-300, 5e-324, 1.0, 1.0 + 2**-52, -7.5, 1e9] + [i / 7 for i in range(40)]
    at = [0, 1, 49, 51, 52, 60, len(values) - 1]
    assert bradley_terry.order_statistics(spark.createDataFrame([(v,) for v in values], "s double"), at) == [sorted(values)[k] for k in at]


def test_many_labels_are_all_fitted(spark, monkeypatch):
    seen, real = [], bradley_terry.fit_blocks
    monkeypatch.setattr(bradley_terry, "fit_blocks", lambda got, *a: seen.append(got.count()) or real(got, *a))
    docs = spark.createDataFrame([(i, ("plain words here. " if i % 3 else "### $$$ ! ") * (i % 7 + 1)) for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["score"] for r in bradley_terry.rank(docs, labels, at_once=50, block=40, buckets=8).collect()}
    assert seen == [200] and all((s >= 0.5) == (i % 3 > 0) for i, s in got.items()) and len(got) == 400

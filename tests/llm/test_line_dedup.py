from collections import defaultdict

from skeinlog.llm import line_dedup as m

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, min_chars=20, min_documents=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                found[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(key(x)) < min_chars or len(found[key(x)]) < min_documents or i == max(found[key(x)])]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def test_equals_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in m.dedup_lines(docs).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_columns_stay(docs):
    out = m.dedup_lines(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped"}


def test_empty_table(no_docs):
    assert m.dedup_lines(no_docs).collect() == []

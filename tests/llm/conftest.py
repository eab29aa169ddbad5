import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, Score string, n_words string"


def words(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empties, blanks, copies, near copies, shared lines, junk and one very long one."""
    rng = random.Random(5)
    out = [None, "", " ", "\n", "\t \n ", "a", "A b", "a  b ", "▁x ▁", "é" * 30, "日本語のテキスト", "1234 5678 !!", "</s>[INST] ok"]
    base = words(rng, 150)
    for k in range(12):  # near copies, some further off
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        out.append(" ".join(w))
    out += [" ".join(base), " ".join(base).upper(), " ".join(base).replace(" ", "\n", 3)]
    out += ["\n".join([f"unique line number {i} of some length", "A line that Many documents share, long enough", "short", "  a line that many documents share, LONG enough\t"]) for i in range(5)]
    out += [" ".join(words(rng, rng.randrange(1, 80))) for _ in range(20)]
    out += [" ".join(words(rng, 20_000, 5_000)), " ".join(["same"] * 200), "# $ % & " * 50]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with those texts, with null ids, languages and sources, repeated rows and clashing extra columns."""
    langs = ["en", "fr", None]
    rows = [(i, t, langs[i % 3], None if i % 7 == 0 else f"src{i % 4}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[20], None, None, None, "x", "y", "z"), (None, None, "en", "src1", 3, None, None, None), (20, "another text under a used id", "en", "src0", 5, "x", "y", "z")]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf_dir(docs, tmp_path_factory):
    """A folder of tables whose documents are docs, for the queries themselves."""
    at = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{at}/documents.parquet")
    return str(at)

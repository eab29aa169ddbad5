import numpy as np

from skeinlog.llm import sentencepiece_codec as m


def test_equals_the_library(docs):
    sp = m.load(m.model_path())
    rows = m.encode(docs, keep=("doc_id", "text")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = sp.encode(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == (sp.decode(ids) if ids else "")


def test_text_form_small_table_and_decode(docs):
    a = {(r["doc_id"], r["ids"]) for r in m.encode(docs, as_array=False, table_words=50).collect()}
    rows = m.decode(m.encode(docs), out="again").collect()
    assert a == {(r["doc_id"], ",".join(map(str, r["ids"]))) for r in rows}
    assert all(r["again"] == r["decoded"] for r in rows)


def test_empty_table(no_docs):
    assert m.encode(no_docs).collect() == []


def test_memory_of_a_table_is_bounded_by_characters():
    """Long words, and many new words at once, reach the library in slices; ids stay those of the library."""

    class Library:
        sent = []

        def __init__(self):
            self.sp = m.load(m.model_path())

        def __getattr__(self, name):
            return getattr(self.sp, name)

        def encode(self, words, **options):
            self.sent.append((len(words), sum(map(len, words))))
            return self.sp.encode(words, **options)

    sp = Library()
    table = m.WordTable(sp, chars=10_000, packed=True, decoded=False)
    for k in range(20):
        text = " ".join(f"{k}-{i}-" + "0f" * 100 for i in range(20))
        ((ids, n, decoded),) = m.encode_texts(table, [text])
        assert np.frombuffer(ids, np.int32).tolist() == sp.sp.encode(text) and n == len(ids) // 4 and decoded is None
        assert sum(map(len, table.ids)) <= 10_000 and not table.text
    sp.sent.clear()
    text = " ".join([*map(str, range(20_000)), "z" * 2_000_000, "a", ""])
    ((ids, _, decoded),) = m.encode_texts(m.WordTable(sp), [text])
    want = sp.sp.encode(text)
    assert ids == ",".join(map(str, want)) and decoded == sp.sp.decode(want)
    assert len(sp.sent) > 2 and all(n <= m.SLICE_WORDS and (size <= m.SLICE_CHARS or n == 1) for n, size in sp.sent)


def test_no_decoded_texts_unless_asked_for(docs):
    coded = m.encode(docs, decoded=False)
    assert coded.columns == ["doc_id", "n_tokens", "ids"]
    assert sorted(map(repr, coded.collect())) == sorted(map(repr, m.encode(docs).drop("decoded").collect()))

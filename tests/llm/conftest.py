import pytest

from tests.conftest import spark  # noqa: F401  (the session fixture)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Columns whose names the operators use themselves.
CLASHES = ["ids", "block", "start", "spans", "words", "pos", "row_id", "text_hash", "n", "cls", "token", "epochs", "cut", "m_lang", "tokens", "key", "window"]


@pytest.fixture
def make_docs(spark):  # noqa: F811
    def make(rows, clashes=False):
        """rows: (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(*r, "en", "src1", len(r[1] or ""))[:2] + ((r[2], r[3]) if len(r) > 2 else ("en", "src1")) + (len(r[1] or ""),) for r in rows]
        docs = spark.createDataFrame(full, DOCS)
        if clashes:
            docs = docs.selectExpr("*", *[f"'{c}' AS {c}" for c in CLASHES])
        return docs
    return make


@pytest.fixture
def odd_docs(make_docs):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(40_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, long), (6, long), (7, "A" * 300_000), (None, "null id here " * 9),
        (None, None), (8, "same text " * 30), (8, "same text " * 30), (8, "another text under this id " * 8), (9, "Ünïcödé ÀÉ 𝒳 " * 20, None, None),
    ]
    return make_docs([r if len(r) > 2 else r for r in rows], clashes=True)

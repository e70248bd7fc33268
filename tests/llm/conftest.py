import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, row_id int, node string, token string, start int"


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text[, lang, source]); further columns clash with the operators' own."""

    def build(rows):
        full = [(*r, None, None)[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or ""), "x", 7, "n", "t", 3) for r in full], DOC_SCHEMA)

    return build


def rows_of(df, *columns):
    """Rows as sorted tuples of the columns."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)

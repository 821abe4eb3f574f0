from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet " * 8000
BASE = " ".join(f"word{i}" for i in range(120))
NEAR = BASE.replace("word60", "other")
PASSAGE = "a passage of well over one hundred bytes that stands in more than one document, word for word and byte for byte, to be found"
ROWS = [
    (1, BASE), (2, BASE), (3, NEAR), (4, None), (5, ""), (6, "   \n\t "), (7, LONG), (8, "Two words"), (9, "two  WORDS"), (9, "two  WORDS"),
    (None, "no id here"), (10, f"before it. {PASSAGE} after it."), (11, f"and here: {PASSAGE} and more of its own"), (12, "été à l'œuvre, 12,3 <|endoftext|>. naïve***"),
    (13, "Released under the MIT License."), (14, "x" * 5000), (15, BASE.replace(" ", "\n", 3)),
]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """Rows with nulls, empty and very long texts, ties and repeats, and extra columns with clashing names."""
    rows = [(i, t, f"s{(i or 0) % 3}" if (i or 0) % 4 else None, -1, "clash", 2.0) for i, t in ROWS]
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, row string, size double").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


CLASHES = ["__rid", "__file", "__number", "__row", "__place", "__slot", "__from", "__to", "__size", "__piece", "rid", "id", "norm", "h", "pass", "slot", "_metadata"]


@pytest.fixture(scope="session")
def corpus(spark, docs, tmp_path_factory):
    """A folder with documents as in ``docs``, more columns named like inner ones, and labels."""
    folder = tmp_path_factory.mktemp("corpus")
    rows = docs.selectExpr("*", "'en' AS lang", "length(text) AS n_chars", *[f"1 AS `{name}`" for name in CLASHES])
    rows.repartition(3).write.parquet(str(folder / "documents.parquet"))
    labels = spark.range(1, 16).selectExpr("id AS doc_id", "1 AS quality", "int(id = 8) AS toxic")
    labels.write.parquet(str(folder / "labels.parquet"))
    return str(folder)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

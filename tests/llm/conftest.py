from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"

EDGE_TEXTS = [
    None, "", " ", "\n\n", "a", "  two  spaces ", "word", "same text here", "same text here",
    "x<|endoftext|>y <|endoftext|> z", "<|endoftext|>", "tab\tand nbsp  x \n y", "é" * 50,
    "日本語 テキスト 🙂 emoji", "it's we're 'll 12 345", "long " * 3000, "y" * 5000, " lead", "trail ",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows and extra columns with clashing names."""
    rows = [(i, t, "x", "src0", i, i, "n") for i, t in enumerate(EDGE_TEXTS)]
    rows.append((7, "same text here", "x", "src0", 7, 7, "n"))
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, part int, ids string",
    )


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

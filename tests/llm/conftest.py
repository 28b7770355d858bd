from __future__ import annotations

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, replica int, row long, key string, n long, node string, level int, name string, k long, `class` string, component_id long, kept boolean"
LONG = "wörd " * 30_000 + "end."


def texts() -> list[tuple[int | None, str | None, str | None, str | None]]:
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, odd characters."""
    return [
        (1, "The cat sat.\nThe dog ran, and it was fun.", "en", "src0"),
        (1, "The cat sat.\nThe dog ran, and it was fun.", "en", "src0"),
        (2, "The cat  sat.\n\nThe dog ran, and it was fun.", "en", "src0"),
        (3, "the CAT sat. the dog ran, and it was fun.", None, "src0"),
        (4, None, None, None),
        (5, "", "en", "src0"),
        (6, " \t\n\r\x0b\x0c ", "en", "src1"),
        (7, LONG, "de", "src0"),
        (8, "x" * 20_000, "de", None),
        (9, "日本語 ▁ \U0001f600 tab\there nul\x00 é", "ja", "src2"),
        (10, "one", "en", "src3"),
        (None, "The cat sat.\nThe dog ran, and it was fun.", "en", "src0"),
        (None, "no id here", None, None),
        (None, None, None, None),
        (11, "To To To To To To To To To To To To", "en", "src0"),
        (11, "To To To To, another text of the same id", "en", "src0"),
    ]


def frame(spark, rows):
    full = [(i, t, lang, s, None if t is None else len(t), 0.5, 9, 9, "k", 9, "n", 9, "n", 9, "c", 9, True) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


@pytest.fixture(scope="session")
def messy(spark):
    return frame(spark, texts()).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def sf_dir():
    from pathlib import Path

    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("no test tables on this machine")
    return path

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, fp long, block long, n_tokens int, component_id long, epoch int, label int, h long"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3, 4, 5, 6, 7, 8) for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with the operators' own names."""
    prose = "The small river runs by the old mill and the people of the town walk there. "
    rows = [
        (1, prose * 8, "en", "src1", 600), (1, prose * 8, "en", "src1", 600), (2, None, "en", "src1", None), (3, "", "de", None, 0), (4, " \n\t ", None, "src2", 4),
        (None, "no id but a text of some words", None, None, None), (5, "ab " * 60_000, "fr", "src3", 180_000), (6, "ü" * 90_000, "de", "src3", 90_000), (7, None, None, None, None),
        (8, prose * 8 + "End.", "en", "src1", 604), (9, "Licensed under the Apache License, Version 2.0.\nmore", "en", "src9", 50), (10, "12 34 !!", "es", "src9", 8), (11, "a\x00b <|endoftext|>   c", "en", "source", 20),
    ]
    return clashing(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return clashing(spark, [])


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark):
    """Awkward documents: null, empty and blank texts, long words, many words,
    repeated rows, copies, near copies, and extra columns of clashing names."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (0, "The Quick  brown fox\tjumps\nover it all", "en", "a"), (1, None, "en", None), (2, "", None, "b"), (3, " \t\n\x0b\x0c\r ", "en", "b"), (4, "x" * 50_000 + " yy", "de", "a"), (5, base * 30, "en", "a"), (6, base, "en", "a"), (7, base.upper(), "en", "a"),
        (8, base + " more", "en", "c"), (9, base.replace("word30", "other"), "fr", "c"), (10, "a b c d", "en", "c"), (11, "a b c d", "en", "c"), (11, "a b c d", "en", "c"), (12, "été ▁ naïve <|endoftext|> <s> 日本語 😀 ½ don't I'LL", "fr", "d"), (None, base, "en", "a"), (13, "a b c d e", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "n": F.lit(1), "fp": F.lit("x"), "key": F.lit(2), "comp": F.lit(3), "rep": F.lit(4), "id": F.lit(5), "label": F.lit(6), "phase": F.lit(7), "i": F.lit(8)})

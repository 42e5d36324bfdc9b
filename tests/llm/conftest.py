import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix potions near old stone bridges".split()


def prose(k: int, n: int = 60) -> str:
    """Plain words, different for each k."""
    return " ".join(f"{WORDS[(k * 7 + j * (k % 5 + 1)) % len(WORDS)]}{'abcdefgh'[(k + j) % 8]}" for j in range(n))


@pytest.fixture(scope="session")
def tricky(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns that clash with results."""
    rows = [
        (1, prose(1), "en", "a", 1), (2, prose(1), "en", "a", 1), (2, prose(1), "en", "a", 1), (3, None, None, None, None), (4, "", "de", "b", 0), (None, prose(2), "fr", None, 5),
        (5, " \n\t ", "en", "b", 4), (6, "one two", "en", "c", 7), (7, prose(3, 4000) + "\n" + prose(3, 50), "de", "c", 9), (8, "日本語のテキスト é ñ 🙂 " * 5, None, "c", 3),
        (9, "x" * 5000, "en", "a", 2), (10, prose(1) + " extra", "en", "a", 1), (11, "line\nline\n\nline\r\nline", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("kept", "n_words", "fingerprint", "component_id", "_row", "_text", "doc", "spans", "score", "_part", "size", "shard", "length")})


@pytest.fixture(scope="session")
def nothing(tricky):
    return tricky.limit(0)

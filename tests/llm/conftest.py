import pytest

TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "One two",
    "a  b   c \n d  e　f",
    "It's <|endoftext|> don't <|endoftext|>",
    "é" * 700 + " ǅ ſ K 日本語 " + "🙂" * 50,
    "x" * 30_000,
    "the quick brown fox " * 3_000,
    "the quick brown fox jumps over the lazy dog and runs away from it all today",
    "the quick brown fox jumps over the lazy dog and runs away from it all today",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and a column with a clashing name."""
    clashing = ("id", "key", "n", "q", "kept", "s", "found", "h", "d2", "h2", "fp", "at", "term", "words", "length", "rank", "t_lang", "held_out", "piece")
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(TEXTS)] + [(3, "one", "en", "src0", 3), (None, "no id here", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    internal = [f"_{c}" for c in (*clashing, "q", "kept", "s", "found", "l", "b", "k", "bucket", "before", "first", "end", "times", "sequence", "offset", "own", "stays", "row", "lang", "source")]
    return docs.selectExpr("*", *(f"'{c}' as {c}" for c in (*clashing, *dict.fromkeys(internal))), "'dot' as `a.b`", "'_' as __q").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

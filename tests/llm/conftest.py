import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    line = "This line of more than twenty characters is shared"
    rows = [
        (1, "", "en", "a"),
        (2, None, "en", None),
        (3, long, None, "b"),
        (4, f"{line}\nown line of the fourth document, long enough", "en", "a"),
        (5, f"  {line.upper()}\t\nshort", "en", "a"),
        (6, f"{line}\n{line}\nmore words of the sixth document here", "de", "b"),
        (6, f"{line}\n{line}\nmore words of the sixth document here", "de", "b"),
        (7, "same text of several words in two documents", "en", "a"),
        (8, "same text of several words in two documents", "en", "a"),
        (None, "a text without an id and with some words", "en", "c"),
        (9, " \n\t ", "en", ""),
        (10, "a b c d e f g h i j\na b c d e f g h i j", "en", "a"),
        (11, "Übung macht den Meister ✓ 漢字 <|endoftext|> ▁x  y", "de", "a"),
        (12, "\n".join(f"paragraph {i} ends here. Released under the MIT License." for i in range(3)), "en", "b"),
    ]
    extra = ["size", "target", "whole", "left", "q", "key", "shard", "slot", "grp", "doc", "hi", "fp", "t", "w", "x1", "n", "row", "k"]
    schema = DOCS + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *["x"] * len(extra)) for i, t, lang, s in rows], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

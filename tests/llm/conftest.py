import pytest

#: Texts that every operator on documents must take: null, empty, blank, ties, repeats,
#: accents, very long words and texts, control characters, special-token strings.
ODD = [
    None, "", " ", "\n\n", "a", "one two", "one two three", "One TWO three four five six seven", "One TWO three four five six seven",
    "é à ü ñ 漢字 🙂 e\u0301", "x" * 5000, "word " * 3000, "tab\tsep\x0bvt\x0cff\rcr\nlf", "it's they'll <|endoftext|> and <|startoftext|>",
    "a\u00a0b\u2003c  d   \n  e", "1234 56,7 $$$ ### ***", "don't you idiot", "line one\nline one\nline two\n\nline one",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, None if i % 3 else "en", None, None, "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, part string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")

import pytest

#: (doc_id, text, lang, source): nulls in each column, empty and long texts, ties, repeated rows, odd characters.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
    (3, "", "en", "b"),
    (4, None, "de", "b"),
    (5, "Write to Jane.Doe+x@mail.example.org or +1 (555) 010-9999 now; ip 10.0.0.255, not 10.0.0.256.", None, "c"),
    (6, "card 4111 1111 1111 1111 and 4111111111111112", "en", None),
    (7, "déjà vu — ünïcödé 中文 🙂 tabs\tand\nlines \x1c\x85 end", "fr", "a"),
    (8, "word " * 30_000, "en", "a"),
    (9, "released under the MIT license; Apache-License, version 2 and CC-BY-NC", "en", "b"),
    (10, "   \n\t ", "en", "c"),
    (10, "   \n\t ", "en", "c"),
    (None, "no key at all", "en", "a"),
    (12, "x" * 70_000, "en", "a"),
    (13, "one", "es", "d"),
    (15, "a@b a@b.c@d.e ..@x-.y +49 170 1234567 1.2.3.4.5.6.7.8", "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}

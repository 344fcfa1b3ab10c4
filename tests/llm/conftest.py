import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(k: int, n: int = 12) -> str:
    return " ".join(WORDS[(k * 7 + j * (k % 5 + 1)) % len(WORDS)] + str((k * j) % 13) for j in range(n)) + "."


LONG = " ".join(sentence(k) for k in range(900))
#: doc_id, text, lang, source, n_chars, and columns whose names clash with those of results and helpers
ROWS = [
    (1, "The quick brown fox\njumps over\tthe lazy dog again and again.", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog again and again.", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, " \t\n ", "en", "b"),
    (6, "one", "en", "b"),
    (7, "One", "en", "c"),
    (8, LONG, "en", "a"),
    (9, LONG + " tail", "en", "a"),
    (10, LONG.replace("alpha", "omega"), "en", "c"),
    (11, sentence(1) + "\n" + sentence(2) + " " + sentence(3), "en", "b"),
    (12, "Start " + sentence(2) + " " + sentence(3) + " end of it", "en", None),
    (13, sentence(1), "de", "a"),
    (14, "Grüße — naïve 日本語 'tis it's 123 \u200b\u2003 \U0001f600\U0001f600!!  x", "de", "c"),
    (15, "\u0558\u1c89 new\u088f letters \ua7dd 12\U00011de0", "xx", "c"),
    (None, "one", "en", "a"),
    (None, sentence(4), "en", "b"),
    (16, sentence(5), "en", "a"),
    (16, sentence(5), "en", "a"),
    (16, sentence(6), "en", "a"),
    (20, "a b c d e f g h i j k l m n o p", "en", "b"),
    (21, "a b c d e f g h i j k l m n o q", "en", "b"),
    (40, "a b c d e f g h i j k l m n o p", None, "b"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, len(r[1]) if r[1] is not None else None, False, 7, "k", 0.5) for r in ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, `row` int, `key` string, _row_key double"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

"""Documents with all that the operators must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, fp string"
_WORDS = {"en": "the of and to in is that it was for on with as by this".split(), "fr": "le la les des et un une que qui dans pour par sur avec pas".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(_WORDS[lang]) + rng.choice(["", "tion", "ment", "er", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(240):
        lang = "en" if i % 3 else "fr"
        out.append((i, sentence(rng, lang, rng.choice([1, 3, 8, 60, 120])), lang, f"s{i % 4}" if i % 5 else "s0", 10, 1, "x", "y"))
    out += [(300 + i, out[10][1], "en", "s1", None, None, None, None) for i in range(30)]  # exact copies
    out += [(400, None, None, None, None, None, None, None), (401, "", "en", None, 0, 0, "", ""), (402, " \n\t ", None, "s2", 0, 0, "", ""), (None, "a text without an id", "en", "s1", 3, 1, "", "")]
    out += [out[3]] * 5  # repeated rows
    out += [(500, sentence(rng, "en", 30_000), "en", "s3", 1, 1, "", ""), (501, "x" * 200_000, None, "s3", 1, 1, "", ""), (502, "12345 !!", None, "s3", 1, 1, "", "")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _id string, body string, _dropped string, label int"
WORDS = "the of and to in is that it for was amber birch cedar delta ember fjord gravel harbor inlet juniper kelp lagoon meadow nettle orchard".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src", None if text is None else len(text), 1.5, "x", "b", "d", 1)


def odd_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, columns whose names operators use themselves."""
    rng = random.Random(7)
    long = "\n".join(sentence(rng, 12) for _ in range(3000))
    plain = [row(k, "\n".join(sentence(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 5)))) for k in range(40)]
    copies = [row(100 + k, plain[0][1]) for k in range(12)]
    near = [row(200 + k, plain[1][1] + " " + WORDS[k]) for k in range(5)]
    shared = [row(300 + k, f"{sentence(rng, 9)}\n Read MORE here \n{sentence(rng, 5)}") for k in range(12)]
    odd = [
        row(400, None), row(401, ""), row(402, " \n\t "), row(403, long), row(404, long), row(405, "x" * 50_000), row(406, "\n\n\n"),
        row(407, "É à ñ Ü ß 日本語 テスト Привет мир"), row(None, "a row without an id and a few more words to count"), row(None, None), row(408, "12 34 ... !!"),
        row(409, plain[2][1], None), row(410, "\x00 \x1c zero \x85 \xa0 bytes"),
    ]
    twice = [plain[3], plain[3], odd[0], odd[1]]
    return plain + copies + near + shared + odd + twice


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)

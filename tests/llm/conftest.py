import random

import pytest

#: Columns that the operators use inside, as extra columns of the input.
EXTRA = ("fp", "chunk", "id", "key", "label", "times", "size", "rank", "found", "bucket", "digits", "n", "h")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
WORDS = "the of and to in it is was that for with able stone river paper cloud green seven light house winter summer engine copper signal market".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + (str(rng.randrange(1000)) if rng.random() < 0.4 else ""))
        if k % 12 == 11:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


def rows_of(texts: list[tuple]) -> list[tuple]:
    return [(i, t, lang, s, None, *("x" for _ in EXTRA)) for i, t, lang, s in texts]


def awkward() -> list[tuple]:
    """Nulls, blanks, repeated rows and ids, odd white space, long texts, copies."""
    base = prose(1, 120)
    texts = [(k, prose(100 + k, 30 + 17 * (k % 9)), "en", f"s{k % 4}") for k in range(20, 50)]
    texts += [
        (1, base, "en", "s0"), (2, base, "fr", "s1"), (2, base, "fr", "s1"), (3, base + " more words here", "en", None), (4, None, None, None), (5, "", "en", "s0"),
        (6, " \t\n\x0b\x0c\r ", "en", "s0"), (7, "one", "en", "s2"), (8, "Two WORDS", None, "s2"), (9, "a  b c d é \U0001f600 \x85x", "es", "s2"),
        (10, prose(5, 4000), "en", "s3"), (11, prose(5, 4000)[2000:9000], "en", "s3"), (None, base, "en", "s0"), (None, None, None, None), (12, "x" * 30_000, "en", "s1"),
        (13, " ".join(["same"] * 300), "en", "s1"), (14, "12345 67890 !?", "en", "s1"),
    ]
    return texts


@pytest.fixture(scope="session")
def table(spark):
    def make(texts):
        return spark.createDataFrame(rows_of(texts), SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(table):
    return table(awkward())


@pytest.fixture(scope="session")
def none(table):
    return table([])

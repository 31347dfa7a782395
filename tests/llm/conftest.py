import random

import pytest

#: Extra columns with names that operators use for their own.
EXTRA = ["row", "doc", "digest", "size", "kept", "fp", "block", "ids"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def frame(spark, rows):
    """Documents from (doc_id, text, source), with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *EXTRA) for i, t, s in rows], SCHEMA)


def prose(seed, words):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 7))) for _ in range(words))


#: Null, empty and odd texts, null ids and sources, repeated rows, ties and one very long text.
ODD = [
    (1, prose(1, 60), "a"), (2, prose(1, 60), "b"), (3, prose(1, 60) + "  \n", "a"), (3, prose(1, 60) + "  \n", "a"),
    (4, None, "a"), (5, "", None), (6, " \t\n\x0b\x0c\r ", "b"), (None, prose(2, 40), "b"), (None, prose(2, 40), None),
    (7, "Grüße, \U0001f600   naïve   İstanbul ſecret=abcdefgh", "ä"), (8, "one", None), (9, "one two", "\U0001f600"),
    (10, "the same eight words stand here twice now " * 40, "z"), (11, "x" * 300_000, "z"), (12, prose(3, 60_000), "a"),
    (2**40, "#*$%&|<> " * 9 + "\na\nb\na\n \n\n", "a"), (-5, prose(4, 50), "a"), (0, prose(4, 50), "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes tables as a folder of Parquet files, like the provided ones."""

    def write(**tables):
        path = str(tmp_path_factory.mktemp("tables"))
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return path

    return write

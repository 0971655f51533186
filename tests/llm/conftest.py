import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega été ñandú über Straße".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


def corpus(seed=1, n=60):
    """(id, text): fresh texts, exact copies with other spacing, near copies, short ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            rows.append((i, (rng.choice(rows)[1] or "").replace(" ", rng.choice([" ", "  ", "\n"]), 3)))
        elif rows and kind < 0.45:
            words = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((i, " ".join(words)))
        elif kind < 0.55:
            rows.append((i, sentence(rng, rng.randint(0, 4))))
        else:
            rows.append((i, sentence(rng, rng.randint(10, 160))))
    return rows


#: Nulls in any column, empty, blank and long texts, repeated rows, an id used twice.
EDGES = [(None, "a text without an id"), (1, None), (2, ""), (3, " \n\t"), (4, "same text here"), (4, "same text here"), (5, "same  text here"), (6, "Word " * 20_000), (7, "x" * 50_000), (4, "other text for the id"), (None, None), (8, "emoji 🙂 and ▁ and \x00 nul")]


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows with extra columns whose names clash with what operators use inside."""
    from pyspark.sql import functions as F

    clash = {c: F.lit("clash") for c in ("score", "id", "n", "h", "norm", "ref", "sig", "tokens", "w", "fp", "size", "key", "ids", "decoded", "cluster", "keep_id", "lang", "source")}
    return spark.createDataFrame(EDGES, "doc_id long, text string").withColumns(clash).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")

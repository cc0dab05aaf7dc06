import random

import pytest

#: Extra columns named like those the operators make themselves.
CLASH = "score double, kept boolean, row long, key long, block long, n long, ids binary, label int, piece int, length long, node long, component_id long"
CLASH_VALUES = (1.0, True, 1, 1, 1, 1, b"x", 1, 1, 1, 1, 1)


@pytest.fixture(scope="session")
def documents(spark):
    """documents frame from (id, text) pairs, with clashing extra columns."""
    def make(rows):
        return spark.createDataFrame([(i, t, *CLASH_VALUES) for i, t in rows], f"doc_id long, text string, {CLASH}")
    return make


def words(seed, n, size=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


#: Null and empty texts, white space, ties, repeated rows, a null id, no-break space, a very long text.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (4, "one"), (5, "ONE"), (None, "one"), (None, None),
    (6, "É é  x\x85y"), (7, "a'b don't  \n\n x<|endoftext|>y  "), (8, " ".join(words(1, 30_000))), (9, "x" * 50_000),
    (10, "the cat sat on the mat the cat sat on the mat"), (10, "other text with that id"),
]


@pytest.fixture(scope="session")
def awkward(documents):
    return documents(AWKWARD)

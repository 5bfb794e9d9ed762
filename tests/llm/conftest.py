import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, places string, c long"


@pytest.fixture
def docs_of(spark):
    """Rows of (doc_id, text) as documents, with extra columns whose names clash with operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z", 1) for i, t in rows], SCHEMA)

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture
def prose():
    """``prose(seed, n)``: n words of lines, the same for the same seed."""
    import random

    def make(seed, n=80):
        rng = random.Random(seed)
        words = [rng.choice(WORDS) + rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)]
        return "\n".join(" ".join(words[i : i + 16]) for i in range(0, n, 16))

    return make


@pytest.fixture
def odd_rows(prose):
    """Nulls, empties, white space, one very long text, repeated rows."""
    return [(None, "some text without a number"), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, prose(4, 40_000)), (5, prose(5)), (5, prose(5)), (6, prose(5)), (7, "one\x00two 😀".encode("utf-16", "surrogatepass").decode("utf-16"))]

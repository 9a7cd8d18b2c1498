import random

import pytest

VOCAB = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "la", "mu", "nu", "xi", "omi", "pi", "rho", "sigma", "tau", "ups", "phi", "chi", "psi", "omega", "été", "größe"]


def make(seed: int, n: int = 60) -> list[tuple]:
    """Rows of documents with copies, near copies, shared passages, odd and empty texts."""
    r = random.Random(seed)
    words = lambda k: [r.choice(VOCAB) + str(r.randrange(40)) for _ in range(k)]
    shared = words(20)
    out = []
    for i in range(n):
        w = words(r.randrange(1, 120))
        if out and i % 5 == 1:
            w = (out[r.randrange(len(out))][1] or "a b").split()
        if i % 10 == 2 and out:
            w = (out[-1][1] or "x").split()
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = "edit"
        if i % 7 == 3:
            w = w[: len(w) // 2] + shared + w[len(w) // 2 :]
        out.append((i, " ".join(w) if i % 3 else "\n ".join(w), "en", f"s{i % 4}" if i % 4 else None, 0))
    out += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \t\n", "en", "s1", 3), (n + 3, "one", "en", "s1", 3), (n + 4, "one", None, "s2", 3), (n + 5, " ".join(words(20_000)), "en", "s2", 0), (n + 6, "x" * 5_000, "en", "s0", 0)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make(1), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

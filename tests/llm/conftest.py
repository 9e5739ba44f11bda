import random

import pytest

#: Names that the operators use inside.
CLASHES = ["score", "_d", "_h", "h", "d", "words", "blob", "_blob", "_spans", "n", "keep", "sha", "node", "own", "_salt", "_hot", "payload", "v", "dim", "y", "chunks", "_column_0"]


@pytest.fixture(scope="session")
def clashing():
    """Adds columns with the operators' inner names to a table."""
    from pyspark.sql import functions as F

    return lambda df: df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES) if c not in df.columns])


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x{r.randrange(9)}" + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def documents():
    """Rows of every odd kind: null and empty texts, copies, near copies, repeated rows, a null id, a very long text."""
    base, passage = prose(1, 120), prose(2, 60)
    rows = [(0, base), (1, base), (2, base.replace(".", "") + " tail"), (3, None), (4, ""), (5, "   "), (6, "one two"), (7, "One  two!"), (8, prose(3, 90)), (8, prose(3, 90)), (None, prose(4, 50)), (None, None)]
    rows += [(9, prose(5, 100) + " " + passage), (10, passage + " " + prose(6, 100)), (11, prose(7, 60_000, 9000)), (12, "é " * 300 + "ß́ 日本語 🙂 end")]
    near = prose(8, 150).split()
    for i in range(13, 33):
        w = list(near)
        w[i * 5 % 150] = f"changed{i}"
        rows.append((i, " ".join(w)))
    return rows


DOCS = "doc_id long, text string"

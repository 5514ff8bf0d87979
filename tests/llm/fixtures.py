"""Small hand-made tables for the operator tests."""

import random

SCHEMA = "doc_id long, text string, lang string, n_chars long"


def words(seed: int, n: int, vocabulary: int = 500) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_rows() -> list[tuple]:
    """Nulls, blanks, copies, near copies, shared passages, repeated ids and a long text."""
    base, passage = words(1, 120), words(2, 60)
    near = list(base)
    near[60] = "changed"
    far = words(3, 120)
    texts = [
        (5, " ".join(base)), (3, " ".join(base)), (9, " ".join(near)), (4, " ".join(far)),
        (7, " ".join(far[:40] + passage + words(4, 30))), (8, " ".join(words(5, 50) + passage)),
        (6, "  \t" + " ".join(passage).upper() + "\x0b\n"), (2, None), (1, ""), (10, " \n\t "),
        (11, "one two"), (12, "One  two"), (13, "one two three four five"), (14, "ONE two\tthree four five"),
        (15, " ".join(["the"] * 200)), (16, " ".join(["the"] * 260)), (5, " ".join(words(6, 70))),
        (None, " ".join(base)), (None, None), (17, "\u00e9t\u00e9 \U0001d54f caf\u00e9 " * 30),
        (18, " ".join(words(7, 4000, 3000))), (19, "x" * 5000 + " " + "y" * 700)]
    return [(i, t, "en", None if t is None else len(t)) for i, t in texts]


def frame(spark, rows=None, schema=SCHEMA):
    return spark.createDataFrame(edge_rows() if rows is None else rows, schema)

"""Small tables with what goes wrong in large ones."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"word{k}" for k in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long_text = prose(1, 60_000)
    base = [(1, prose(2, 60)), (2, prose(2, 60)), (3, None), (4, ""), (5, "   \n\t "), (6, long_text), (7, "x" * 300_000), (8, "one two three"), (9, "One  two three"), (10, "é" * 5), (11, "é" * 5)]
    rows = [(i, t, "en", "a" if i % 2 else None, len(t) if t is not None else None) for i, t in base]
    return [*rows, rows[0], (None, prose(3, 50), None, None, None), (None, None, None, None, None)]


def odd(spark):
    """The same with columns of names that operators use for themselves."""
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    clash = "score rate copy mix_key slot shard digest key bucket comp hits n h size item_id start word part"
    for name in clash.split():
        df = df.selectExpr("*", f"'mine' as {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

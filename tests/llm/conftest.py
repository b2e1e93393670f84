from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def words() -> list[str]:
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(2, 8))) for _ in range(800)]


@pytest.fixture(scope="session")
def corpus(words: list[str]) -> list[tuple[int, str | None]]:
    """Texts with copies, near copies, shared passages, repeats, odd white space, nulls and empty ones."""
    rng = random.Random(11)

    def text(n: int) -> str:
        out = []
        for i in range(n):
            out.append(rng.choice(words))
            out.append(rng.choice([" "] * 12 + ["\n", "  ", " \t", "\u00a0 ", ". ", "\x0b"]))
        return "".join(out)

    passage, base = text(70), text(200)
    rows: list[tuple[int, str | None]] = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "one two three four")]
    rows += [(10 + i, text(rng.randint(1, 300))) for i in range(40)]
    rows += [(60 + i, text(30) + passage + text(40)) for i in range(8)]
    rows += [(70 + i, base) for i in range(5)]
    for i in range(12):
        w = base.split(" ")
        for _ in range(1 + i // 3):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((80 + i, " ".join(w)))
    rows += [(100, ("la li lu " * 60)), (101, ("la li lu " * 61)), (102, text(6000)), (103, passage), (104, base + " " + passage), (5, "one two three four")]
    rng.shuffle(rows)
    return rows

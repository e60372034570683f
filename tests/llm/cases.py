"""Documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, th long, doc long, fp long, component_id long, shard int, bucket int"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéßn") for _ in range(r.randint(1, 8))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    a = words(90, 1)
    out = [(1, None), (2, ""), (3, " \n\t "), (4, a), (5, a), (5, a), (None, a), (None, None), (6, words(6000, 2)), (7, "one"), (8, "a▁b ☃ 日本\x00\n\n"), (9, "w " * 500)]
    return out + [(20 + k, words(30 + k, 100 + k)) for k in range(12)]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "r", 0.5, 1, 2, 3, 4, 5, 6) for i, t in rows], SCHEMA)

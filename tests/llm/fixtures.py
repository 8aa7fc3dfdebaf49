"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, ah long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


def documents(spark):
    shared = prose(1, 60)
    rows = [
        (1, prose(2, 80) + " " + shared + " " + prose(3, 40)), (2, prose(4, 50) + " " + shared), (3, shared), (4, shared), (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "one"),
        (10, "two words"), (11, prose(5, 120)), (12, prose(5, 120).replace("w1", "v1", 1)), (13, "again " * 100), (14, prose(6, 900)), (15, prose(6, 900) + " tail"), (16, "é" * 300 + " " + shared),
        (17, prose(7, 30)), (17, prose(7, 30)), (18, prose(7, 30).upper()),
    ]
    return spark.createDataFrame([(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), 1, "k", 2) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

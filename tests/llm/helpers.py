"""Small tables that every operator has to take: nulls, empty and very long texts, ties, repeated rows, extra columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "slot int, shard int, component_id long, line_report string, ids string, class string, n long, part int")
EXTRA = (7, 7, 7, "x", "x", "x", 7, 7)


def words(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


def awkward_rows(seed=1):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    base = words(rng, 60, stock)
    near = base.split()
    near[30] = "changed"
    rows = [(1, None, "en", "s0"), (2, "", "en", None), (3, " \t\n ", None, "s1"), (4, "one", "en", "s0"), (5, "One", "de", "s1"),
            (6, "a b c d", None, "s0"), (7, base, "en", "s0"), (8, base, "en", "s1"), (9, " ".join(near), "en", "s2"),
            (9, " ".join(near), "en", "s2"), (10, base.upper(), "de", "s3"), (None, base, "en", "s0"), (None, None, None, None),
            (11, words(rng, 30_000, stock), "en", "s0"), (12, "x" * 5_000, "de", "s0"), (13, "12 34 ½ !!", "de", "s1"),
            (14, "a  b \n\n c\t<|endoftext|> d", "en", "s1"), (15, "日本 語 😀 ́ İΣ", None, "s2")]
    rows += [(100 + i, words(rng, rng.randint(5, 40), stock), rng.choice(["en", "de"]), f"s{i % 4}") for i in range(40)]
    return [(*r, None if r[1] is None else len(r[1]), *EXTRA) for r in rows]


def awkward(spark, seed=1):
    return spark.createDataFrame(awkward_rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

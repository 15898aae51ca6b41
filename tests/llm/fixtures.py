"""Small tables that hold every odd case: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHES = ["key", "content", "rid", "row_key", "seed", "item", "comp", "_size", "digest", "n", "copied", "starts", "ll", "repeats", "kept"]


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows(seed: int = 3) -> list[tuple]:
    """(doc_id, text, lang, source) with copies, near copies, shared passages, long, blank, empty and null texts."""
    rng = random.Random(seed)
    out: list[tuple] = []
    passage, base = words(rng, 80), words(rng, 120)
    for i in range(40):
        w = words(rng, rng.randrange(1, 200))
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[rng.randrange(20) :]
        out.append((i, " ".join(w), "en", f"s{i % 3}"))
    for i in range(40, 70):  # near copies of one text, many of them not of each other
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        out.append((i, " ".join(w), "fr", "s0"))
    out += [(70 + i, out[5][1], "en", None) for i in range(5)]  # exact copies
    out += [(80, None, None, None), (81, "", "en", "s1"), (82, " \t\n ", "de", "s1"), (83, "one", None, ""), (84, "one", "en", "s1"), (85, "   é 日本語 𝒳 ß", "de", "s2")]
    out += [out[7], out[7], (7, "another text of the same id", "en", "s1"), (None, out[9][1], "en", "s1"), (None, None, None, None)]
    out += [(90, " ".join(words(rng, 6000)), "en", "s0"), (91, "y" * 70_000, "en", "s0"), (92, " ".join(passage * 3), "en", "s1")]
    return out


def documents(spark: SparkSession, clashing: bool = False, data: list[tuple] | None = None) -> DataFrame:
    got = [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in (rows() if data is None else data)]
    df = spark.createDataFrame(got, DOCS).repartition(5)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("?") for c in CLASHES})
    return df


def result(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)

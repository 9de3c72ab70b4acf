"""Small documents shared by the operator tests: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
CLASHING = "text long, k long, part int, at long, row string, rid long, fp long, h long, salt int, ms string, " \
           "kept boolean, clean_text string, score double, label string, g int, used int, span string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)) + "."


def texts(seed=0, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append("\n".join(sentence(rng, rng.randrange(4, 30)) for _ in range(rng.randrange(1, 6))))
    out += [out[0], out[1] + " tail", out[2].replace("alpha", "beta", 1), None, "", " \n\t ", "one", "a b",
            "Ünïcode wörds   x y", " ".join(sentence(rng, 40) for _ in range(150))]
    return out


def documents(spark, seed=0, n=40, repeated=True):
    """doc_id, text and columns whose names the operators use inside."""
    rows = list(enumerate(texts(seed, n))) + [(None, "no id here, but some words to read and to keep " * 3)]
    if repeated:
        rows += [rows[3], rows[3], (5, "the same id with another text " * 8)]
    extra = [f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASHING.split(", ")[1:]]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *extra), rows


def empty(spark, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame([], schema)

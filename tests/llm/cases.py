"""Awkward documents that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for results or inside, carried along as columns of the input.
CLASHES = ["score", "toxicity", "kept", "keep", "n", "key", "word", "fp", "bundle", "part", "rank", "block", "offset"]
BLANK_ENDS = " \t\r\x0b\x0c"


def sentence(rng, words=30):
    return " ".join(rng.choice(["Alpha", "beta", "gámma", "delta,", "eps.", "the", "of", "x1"]) for _ in range(words))


def documents(seed=1, plain=60):
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randint(1, 60)), rng.choice(["en", "de"]), "s", 0) for i in range(plain)]
    shared = "This very line is shared by many documents"
    rows += [(100 + i, f"{sentence(rng)}\n{shared.upper() if i % 2 else shared}{BLANK_ENDS}\nend {i}", "en", "s", 0) for i in range(6)]
    rows += [(200 + i, "exact copy of a text with some more words in it", "en", "s", 0) for i in range(5)]
    rows += [
        (300, None, None, None, None),
        (301, "", "en", "s", 0),
        (302, " \n\t\n ", "en", "s", 0),
        (303, "one", "en", "s", 3),
        (304, "word " * 20_000, "en", "s", 0),
        (305, "x" * 50_000, "de", "s", 0),
        (306, "ÄÖ ß 中文 😀 é\n\n\n", "xx", "s", 0),
        (307, "same words here " * 40, "en", "s", 0),
        (307, "same words here " * 40, "en", "s", 0),
        (307, "another text of the same id", "en", "s", 0),
        (None, "a text without an id", "en", "s", 0),
        (None, None, "en", "s", 0),
    ]
    return rows


def frame(spark, rows, partitions=3):
    made = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    return made.selectExpr("*", *[f"concat('own ', doc_id) AS {name}" for name in CLASHES])

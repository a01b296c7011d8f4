"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, fp long, key string, row string, spans string, score double, words string, chunk long, taken long"
WORDS = "alpha beta gamma delta omega river stone cloud light winter summer garden window paper silver copper forest harbour lantern meadow".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n)) + "."


def awkward_rows() -> list[tuple]:
    shared = prose(99, 60)
    texts = {
        0: prose(0, 40), 1: prose(1, 40), 2: prose(0, 40), 3: "", 4: None, 5: " \t\n\x0b ", 6: "one two", 7: prose(7, 30) + "\n" + shared, 8: shared + " " + prose(8, 25),
        9: prose(9, 40) + ' token = "abc123def456" AKIA' + "Z" * 16 + " " + "0f" * 15, 10: "word " * 400, 11: "É ß ñ 漢字 \U0001f600 " * 12, 12: "a" * 3000, 13: prose(13, 4000),
        14: prose(0, 39) + " changed0.", 15: "stupid idiot. " + prose(15, 22), 16: "\x00\x01 zero " * 20,
    }
    sources = ["a", "a", "b", None, "a", "c", "a", "b", "a", "é", "a", None, "a", "b", "a", "c", "a"]
    rows = [(k, t, "en", sources[k], None, 7, 1.0, 3, "k", "r", "s", 0.5, "w", 1, 2) for k, t in texts.items()]
    rows += [rows[0], rows[0], (None, prose(77, 30), None, "a", None, *rows[0][5:]), (None, None, None, None, None, *[None] * 10), (1, prose(78, 30), "en", "b", None, *rows[0][5:])]
    return rows


def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)

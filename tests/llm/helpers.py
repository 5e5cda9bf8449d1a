"""Small tables and brute-force versions shared by these tests."""

import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, clash=True):
    """Documents from (doc_id, text); ``clash`` adds columns with names that operators use inside."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    if clash:
        for name in ("fp", "grp", "score", "h", "key", "seed", "x", "_id", "_text", "kept", "label"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def long_text(n=60_000):
    return " ".join(f"w{i * 7919 % 100_003}" for i in range(n))


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "one two"), (6, "one two"),
        (None, "a null id has words as well"), (7, "Ünï çødé ñ 日本語 🙂 text"), (8, "x" * 30_000)]

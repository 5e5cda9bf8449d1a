from pyspark.sql import functions as F

from webloom.operators.language import (FIXTURE_DICTIONARY, ISO639_3, detect_language, train_profiles,
                                        translate_queries)


def test_detect_accuracy(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "lang")
    train = docs.where(F.col("doc_id") % 2 == 0)        # held-out check: train on even, test on odd ids
    test = docs.where(F.col("doc_id") % 2 == 1)
    prof = train_profiles(train, "doc_id", "text", "lang")
    det = detect_language(test, "doc_id", "text", prof).join(test, "doc_id")
    m = F.create_map(*[F.lit(x) for kv in ISO639_3.items() for x in kv])
    scored = det.where(F.length("text") >= 10).select((F.col("lang_code") == F.element_at(m, F.col("lang"))).alias("ok"))
    n, ok = scored.count(), scored.where("ok").count()
    assert n > 0 and ok / n >= 0.95
    short = det.where(F.length("text") < 10).select("lang_code").distinct().collect()
    assert all(r.lang_code == "und" for r in short)


def test_translate(spark):
    df = spark.createDataFrame([(1, "Le chat et la souris", "fra"), (2, "the cat", "eng"), (3, "x", "und")],
                               "id long, text string, code string")
    out = {r.id: r.query for r in translate_queries(df, "text", "code", FIXTURE_DICTIONARY).collect()}
    assert out == {1: "the chat and the souris", 2: "the cat", 3: "x"}

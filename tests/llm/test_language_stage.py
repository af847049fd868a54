"""What the pipeline's language stage keeps."""

import random
import string

from pyspark.sql import functions as F

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


def documents(spark, extra):
    source = spark.read.parquet(f"{DIR}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    return source.union(spark.createDataFrame([(i, t, None, None, None) for i, t in extra], source.schema))


def test_junk_with_letters_goes(spark):
    rng = random.Random(3)
    letters = string.ascii_letters + string.digits
    word = lambda: "".join(rng.choice(string.ascii_letters) for _ in range(rng.randint(2, 9)))
    junk = [(90_000, "".join(rng.choice(letters) for _ in range(900))), (90_001, " ".join(word() for _ in range(150))), (90_002, "x" * 900), (90_003, "12 34"), (90_004, None)]
    docs = documents(spark, [*junk, (90_010, "Zyx"), (90_011, " ".join(r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(3).collect()))])
    got = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, DIR).collect()}
    assert got == {r.doc_id for r in docs.collect()} - {i for i, _ in junk}


def test_unlabelled_documents_stay(spark):
    docs = documents(spark, [(90_000, "12 34"), (90_001, None), (90_002, "é")]).withColumn("lang", F.lit(None).cast("string"))
    got = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, DIR).collect()}
    assert got == {r.doc_id for r in docs.collect()} - {90_000, 90_001}

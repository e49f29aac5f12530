"""Calibrated rejection: unseen languages and random letters go, held-out documents stay."""

import random

import pytest
from pyspark.sql import functions as F

from weft.llm import langid

SF = "/root/testdata/sf0.01"
OTHER = [
    "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και τρέχει στο δάσος",
    "これは日本語のテキストです。とても長い文章をここに書いています。今日は天気がいいですね。",
    "Быстрая коричневая лиса прыгает через ленивую собаку и убегает в тёмный лес",
    "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee sitten syvälle metsään",
    "Szybki brązowy lis przeskakuje nad leniwym psem, po czym ucieka do ciemnego lasu",
    "빠른 갈색 여우가 게으른 개를 뛰어넘어 깊은 숲 속으로 달려갑니다",
    "Sự nhanh nhẹn của con cáo nâu khiến nó nhảy qua con chó lười biếng rồi chạy vào rừng",
]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit(docs, "doc_id", "text", "lang", langid.training_fold())


def test_held_out_rows_stay(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL").where(~langid.training_fold())
    r = langid.predict(docs, model).agg(F.avg(F.col("rejected").cast("int")).alias("r"), F.count(F.lit(1)).alias("n")).first()
    assert r.n > 100 and r.r <= 0.02
    assert langid.keep_known(docs, model).count() >= 0.98 * r.n


def test_other_languages_and_random_letters_go(spark, model):
    rng = random.Random(1)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(rng.randint(15, 60))) for _ in range(50)]
    texts = OTHER + noise
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.rejected for r in langid.predict(rows, model).collect()}
    assert all(got[i] for i in range(len(OTHER)))
    assert sum(got[i] for i in range(len(OTHER), len(texts))) >= 0.9 * len(noise)
    left = {r.doc_id for r in langid.keep_known(rows, model).collect()}
    assert left == {i for i in got if not got[i]}


def test_temperature_lies_inside_its_grid(model):
    assert 0.021 < model.temperature < 49 and 0 < model.threshold < 1 and model.share < 0.1

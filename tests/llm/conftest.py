import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty, blank and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    base = "the and of to in a that is was he for it with as his on be at by i this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old life both between being under three never know same last another while us might great go come since against right came take used himself few house use place during without again home small around however"
    words = base.split()
    rows = [(i, " ".join(words[(i * 7 + k * (i % 5 + 1)) % len(words)] for k in range(40 + i)) + f" ending {i}.", ("en", "de", None)[i % 3], (None, "b", "a", "c")[i % 4], 1) for i in range(24)]
    rows += [(30, rows[3][1], "en", "a", 1), (31, rows[3][1], "de", "b", 1), (32, None, "en", "a", None), (33, "", None, None, 0), (34, " \t\n ", "en", "a", 3), (35, "7 + 8 !", "en", "a", 7)]
    rows += [(36, "É" * 3 + " naïve " + "déjà vu " * 4000, "fr", "c", None), (37, "x" * 70000, "en", "c", 1), rows[0], rows[0], (None, "no id at all, but some words", "en", "a", 1), (None, None, None, None, None)]
    rows += [(40, rows[5][1] + " tail", "en", "a", 1), (41, "😀 emoji   line <|endoftext|> <s> ▁ ŉ ª ² ǅ \x1c   K'S don't it's 'S Straße", "de", "b", 1)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("size", "shard", "fp", "mark", "doc", "score", "bucket", "part", "taken", "codes", "lang_pred", "u", "root"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def saved(odd, tmp_path_factory):
    """The odd documents as a folder of tables."""
    folder = tmp_path_factory.mktemp("odd")
    odd.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def saved_none(none, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    none.write.parquet(f"{folder}/documents.parquet")
    return str(folder)

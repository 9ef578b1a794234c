import random

import pytest
from pyspark.sql import functions as F

from netsilt.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "netsilt-llm-tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, and other
    columns whose names operators might use themselves."""
    rng = random.Random(7)
    long = " ".join(words(rng, 60_000))
    base = " ".join(words(rng, 300))
    texts = ["", None, "  \n\t ", "one", "one two", base, base, base + " tail", long, "Été üß 한국 <|im_end|> \\1",
             "x" * 5000, "12 34 .. !!", base.upper(), " ".join(words(rng, 80)), "a\x00b c\x1fd"]
    rows = [(i, t, "en" if i % 2 else "de", None if i % 3 else "s") for i, t in enumerate(texts)]
    rows += [(None, base, None, None), (None, None, "fr", None), (3, "one", "en", "s"), (3, "one", "en", "s"), (-5, "one two", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("fp", "digest", "rid", "key", "row", "n_words", "n_removed", "score", "label", "shard", "bucket", "piece", "id", "draw", "letters",
                 "_", "__", "_text", "_digest", "_doc", "_digest_kept", "_doc_kept", "_leaked", "_of", "of", "item_id", "words"):
        df = df.withColumn(name, F.lit("clash"))
    return df

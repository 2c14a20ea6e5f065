import random

import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string"


@pytest.fixture
def docs_of(spark):
    """Documents from a list of texts, ids in order, over a few partitions."""
    return lambda texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOC).repartition(3, F.col("doc_id"))


@pytest.fixture
def prose():
    """Deterministic random prose: ``prose(words, seed)``."""
    def make(n, seed, vocabulary=400):
        r = random.Random(seed)
        return " ".join("w" + str(r.randrange(vocabulary)) for _ in range(n))

    return make

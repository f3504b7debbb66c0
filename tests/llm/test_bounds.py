"""What a plan passes through the driver or one task stays bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillspark.llm")
from quillspark.llm import ann


def test_visits_of_queries_are_not_broadcast(spark):
    x = np.random.default_rng(4).standard_normal((300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(df, F.col("vec_id") % 100 == 0, 5)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 15

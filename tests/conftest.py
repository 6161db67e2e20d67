import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def quick_fits(monkeypatch):
    """Families with one point a grid and few steps, where a test is not about what they learn."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.tuning import ParamGridBuilder

    from phenoframe.operators import ml

    lr = LogisticRegression(labelCol="label", maxIter=4, regParam=0.01)
    monkeypatch.setattr(ml, "families", lambda label="label", weight=None, seed=42: {"logistic": (lr, ParamGridBuilder().addGrid(lr.regParam, [0.01]).build())})

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("rankfold-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def coo(spark):
    """Entries and the dense matrix they stand for."""
    import numpy as np

    from rankfold import Matrix

    def make(dense, n_rows=None, n_cols=None):
        dense = np.asarray(dense, dtype=float)
        cells = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
        df = spark.createDataFrame(cells, "row_id bigint, col_id bigint, value double")
        return Matrix(df, n_rows or dense.shape[0], n_cols or dense.shape[1])

    return make

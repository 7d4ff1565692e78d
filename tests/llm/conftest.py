import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, schema): a small table in three partitions."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)
    return make

import pytest

from linewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, spark__driver__memory="4g")


@pytest.fixture
def one(spark):
    """The value of a Column expression over one string (or bytes)."""
    from pyspark.sql import functions as F

    def value(make, text):
        return spark.range(1).select(F.lit(text).alias("v")).select(make(F.col("v")).alias("out")).first()["out"]

    return value

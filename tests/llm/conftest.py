import pytest

from dialsieve.llm.common import prepare


@pytest.fixture()
def docs(spark):
    """Make a documents table; extra columns carry names that the operators use inside."""
    prepare(spark)

    def make(rows, kind="doc_id long, text string, source string"):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(rows, kind)
        return df.withColumns({c: F.lit(1) for c in ("id", "key", "n", "g", "part", "h", "size", "score", "component")})
    return make

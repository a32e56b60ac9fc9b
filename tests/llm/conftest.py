import pytest

from lociforge.llm.store import ship


@pytest.fixture(scope="session")
def llm(spark, tmp_path_factory):
    """The session with the package at hand in its Python workers and a checkpoint folder of its own."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    ship(spark)
    return spark

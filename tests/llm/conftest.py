import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Staged tables of this package's tests go where ``spark.checkpoint.dir`` says."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) with extra columns whose names clash with those that operators make."""

    def make(rows, extra=True):
        frame = spark.createDataFrame(
            [(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, score string, n_words int, hash int"
        )
        return frame if extra else frame.select("doc_id", "text")

    return make

"""Every query of the text operators on tables without rows."""

from pathlib import Path

import pytest

from symloom.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty_texts")
    for path in DATA.glob("*.parquet"):
        spark.read.parquet(str(path)).limit(0).write.parquet(str(folder / path.name))
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []

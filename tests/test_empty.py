"""Every query of the core on tables without rows: none fails, and columns stay."""

from pathlib import Path

import pytest

from symloom.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")
#: Queries that give rows for no input: totals, and the parsers' own sample tree.
ALWAYS = ("sc12", "ag01", "ag03", "ag13", "st01", "sc10", "ig05", "pr07", "au12")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for path in DATA.glob("*.parquet"):
        spark.read.parquet(str(path)).limit(0).write.parquet(str(folder / path.name))
    return str(folder)


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if not n.endswith("_sample")))
def test_no_rows(spark, empty, name):
    rows = registry.queries()[name](spark, empty).collect()
    assert not rows or name.startswith(ALWAYS)

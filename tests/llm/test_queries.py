"""Each query with SQL against DuckDB, over the smallest tables."""

import os

import pytest

from docloom.llm.common import ensure_checkpoint_dir
from docloom.llm.queries import QUERIES, SQL

from ..duck import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    same_rows(QUERIES[name](spark, SF), SQL[name], SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session)

"""Every registered query of the package on the smallest tables."""

import pytest
from oracle import compare, connect

from twinledger.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    query, sql = QUERIES[name]
    frame = query(spark, SF_DIR)
    if sql is not None:
        assert compare(frame, connect(SF_DIR), sql) is None
    else:
        n = frame.count()
        per_row = name.split("_")[0] in ("op3", "op5", "op7", "op9", "op12", "op13")
        assert n == spark.read.parquet(f"{SF_DIR}/documents.parquet").count() if per_row else n > 0

"""Every query of the library against its SQL at the smallest scale."""

from __future__ import annotations

import pytest
from compare import same

import __spark_entry__
from corpusmill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, duck):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in catalog.SQL:
        same(got, duck.sql(catalog.SQL[name]).df())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["block_id", "n_tokens", "n_lines"]
    assert rows.count() > 0


def test_oracle_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_duplicate_registration_is_an_error():
    with pytest.raises(ValueError):
        catalog.query(name="sample_n")(lambda s, d: None)

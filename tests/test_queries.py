"""Every registered query of the library against its SQL at the smallest scale; those without run."""

import pytest

from tarnlake.plans.registry import FLAGSHIP, ORACLES, QUERIES

from compare import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, data):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        same(df, duck, ORACLES[name])
    else:
        df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__

    assert FLAGSHIP in __spark_entry__.queries()
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every core query against its SQL."""

import pytest
from conftest import SF

from lodestone.plans import codec_queries, kernels, map_queries, registry  # noqa: F401


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def test_every_query_has_an_oracle():
    assert set(registry.ORACLES) == set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(plain(tuple(r))) for r in df.select(*cols).collect())
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    order = sorted(range(len(names)), key=names.__getitem__)
    assert got == sorted(repr(plain(tuple(r[i] for i in order))) for r in found.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

import pytest

from reelframe.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _rows(names, rows):
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(f"{n}={show(v)}" for n, v in sorted(zip(names, r))) for r in rows)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLE_SQL[name])
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == want and got

"""Every ledger query against its SQL on the smallest tables."""

import duckdb
import pytest

from ledgerloom import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "orders", "events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    ours = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    theirs = db.execute("SELECT {} FROM ({})".format(", ".join(f'"{c}"' for c in cols), catalog.oracle_sql()[name])).fetchall()
    assert ours and ours == sorted(map(str, theirs))

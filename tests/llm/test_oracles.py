import math
from pathlib import Path

import duckdb
import pytest

from colophon.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def comparable(frame):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
            return None
        if isinstance(x, float):  # pandas makes whole numbers with nulls floats
            return str(int(x)) if x.is_integer() else repr(round(float(x), 6))
        return str(x)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(([plain(x) for x in row] for row in frame.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    assert comparable(QUERIES[name](spark, str(DATA)).toPandas()) == comparable(con.execute(ORACLES[name]).df())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

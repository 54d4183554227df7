"""Every registered query of the library against its SQL in DuckDB, on the small tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tidewater.plans import catalog

AT = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not AT.exists(), reason="no test tables")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = __spark_entry__.queries()[name](spark, str(AT))
    if name not in catalog.ORACLES:
        assert got.count() > 0
        return
    with duckdb.connect() as con:
        con.sql("set timezone = 'UTC'")
        for f in AT.glob("*.parquet"):
            con.sql(f"create view {f.stem} as select * from '{f}'")
        want = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(names)
        assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())


def test_file_names_of_long_numbers(spark, tmp_path):
    """Numbers of more digits than the names are padded to."""
    spark.createDataFrame([(i, "u", "h") for i in (0, 7, 99_999, 100_000, 123_456, 9_876_543_210)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = __spark_entry__.queries()["file_names"](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
        want = con.execute(catalog.ORACLES["file_names"])
        names = [d[0] for d in want.description]
        assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())

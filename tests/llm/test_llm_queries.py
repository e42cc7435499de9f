import duckdb
import pytest

from glyphspark.llm import queries as llm

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None).astype(str)
    return sorted(map(tuple, frame.values.tolist()))


@pytest.mark.parametrize("name", ["op1_mixing", "op6_line_dedup", "op8_warc"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows(llm.queries()[name](spark, SF).toPandas()) == rows(con.execute(llm.oracle_sql()[name]).df())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 11))

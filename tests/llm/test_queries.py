"""Every registered query of the subpackage on the smallest tables: with SQL against DuckDB, the others for rows and columns."""

import os
from numbers import Number

import duckdb
import pandas as pd
import pytest

from lexiloom.llm import oracle, queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p2_split": {"email_id", "split"}, "p2_balance": {"split", "label", "n"}, "p3_found": {"email_id", "kind", "value"}, "p3_pseudonymised": {"email_id", "text", "n_items"}, "p5_found": {"email_id"},
    "p5_restored": {"email_id", "restored"}, "p8_selection": {"doc_id", "source", "copies", "tokens"}, "p9_found": {"doc_id"}, "p9_labels": {"label", "found_by", "n_documents"},
    "p8_report": {"source", "target_share", "wanted_share", "documents", "budget", "epochs", "tokens", "actual_share"},
}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(df):
    shown = lambda v: "null" if pd.isna(v) else repr(float(v)) if isinstance(v, Number) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(shown, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sql, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    if name not in oracle.oracle_sql():
        assert set(got.columns) == COLUMNS[name] and len(got)
        return
    wanted = sql.sql(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns) and plain(got) == plain(wanted)

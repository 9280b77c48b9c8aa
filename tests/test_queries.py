"""Every registered query of the core with SQL against DuckDB on the smallest tables, the others for rows."""

import os
from numbers import Number

import duckdb
import pandas as pd
import pytest

from lexiloom.plans import oracle, queries

DATA = "/root/testdata/sf0.001"
NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(df):
    """Rows as sorted texts, columns by name, numbers alike whatever their type."""
    shown = lambda v: "null" if pd.isna(v) else repr(float(v)) if isinstance(v, Number) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(shown, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    if name not in oracle.oracle_sql():
        assert len(got)
        if "pass" in got:
            assert got["pass"].all(), got[~got["pass"]]
        for score in {"precision", "recall", "f1", "accuracy", "auc"} & set(got.columns):
            assert got[score].between(0, 1).all()
        return
    wanted = sql.sql(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert plain(got) == plain(wanted)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_html_parts_against_plain_python(spark):
    """No SQL decodes charsets and entities, so the whole query is compared with the standard library."""
    import html
    import re

    parts = pd.read_parquet(f"{DATA}/message_parts.parquet")
    parts = parts[(parts["ctype"] == "text/html") & parts["payload"].notna()]

    def plain_text(data, charset):
        try:
            text = data.decode(charset or "utf-8", errors="replace")
        except LookupError:
            text = data.decode("utf-8", errors="replace")
        text = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", text)
        text = re.sub(r"(?i)<br\s*/?>|</p>|</div>|</tr>|</li>", "\n", text)
        return html.unescape(re.sub(r"<[^>]+>", " ", text))

    wanted = {(r.source, r.msg_no, r.part_no, plain_text(r.payload, r.charset)) for r in parts.itertuples()}
    got = {tuple(r) for r in queries.queries()["html_to_text"](spark, DATA).select("source", "msg_no", "part_no", "text").collect()}
    assert got == wanted and len(got) > 10

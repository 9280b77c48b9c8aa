"""The entry point, and the rule that nothing outside lexiloom.llm needs it."""

import pathlib
import re

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_core_imports_nothing_of_the_subpackage():
    for path in (ROOT / "lexiloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"lexiloom(\.|\s+import\s+)llm", path.read_text()), path


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_local_checkpoint_or_cross_join_of_rows():
    for path in (ROOT / "lexiloom").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text
        for line in text.splitlines():
            assert "crossJoin" not in line or "broadcast" in line, (path, line)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "source"

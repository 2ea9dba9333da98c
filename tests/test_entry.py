import re

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert all(re.fullmatch(r"\w+", n) for n in names)

"""Every query of the core against its SQL."""

import pytest
from quillstack.plans import queries as core

from .conftest import DATA, same_as_sql


@pytest.mark.parametrize("name", core.QUERIES)
def test_query_equals_its_sql(spark, name):
    same_as_sql(core.QUERIES[name](spark, DATA), core.ORACLE_SQL[name], ordered=name in core.ORDERED)


def test_entry_has_a_schema(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:2] == ["name", "filename"]
    assert set(core.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_blank_is_judged_on_whole_texts(spark):
    rows = [(1, "en", "web", " " * 30 + "words"), (2, "en", "web", " \n" * 30), (3, "en", "web", ""), (4, "en", "web", "words")]
    got = core._padding(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()
    assert {r["doc_id"]: r["blank"] for r in got} == {1: False, 2: True, 3: True, 4: False}

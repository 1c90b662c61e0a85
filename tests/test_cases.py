"""Cases over a few invented rows, held against the SQL that states their results."""

import duckdb
import pytest

from actlake.plans import queries as Q

STATED = {name: case for name, case in Q.cases().items() if case[1]}


@pytest.mark.parametrize("name", sorted(STATED))
def test_case_equals_its_sql(spark, name):
    query, sql = STATED[name]
    found = query(spark, "/root/testdata/sf0.001")
    told = duckdb.connect().sql(sql)
    assert sorted(found.columns) == sorted(told.columns)
    order = sorted(found.columns)
    plain = lambda rows, columns: sorted(str(tuple(str(dict(zip(columns, r))[c]) for c in order)) for r in rows)  # noqa: B905, E731
    assert plain(found.collect(), found.columns) == plain(told.fetchall(), told.columns)


def test_cases_are_no_queries():
    assert not set(Q.cases()) & set(Q.queries()) and len(STATED) > 20

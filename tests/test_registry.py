import __spark_entry__ as entry


def test_names_agree():
    known = entry.queries()
    assert len(known) > 60
    assert set(entry.oracle_sql()) <= set(known)

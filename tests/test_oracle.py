"""Every registered query of the relational surface gives the rows of its SQL."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from marlstone import plans

from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_rows(spark, name):
    df = plans.queries()[name](spark, SF)
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert oracle.difference(df, SF, sql) is None


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sections_trim_spaces_only(spark, tmp_path):
    """Lines that begin or end with digits of their own number or with spaces, blank ones, and texts without any line."""
    numbers = "\n".join(f"{i} the line {i}" for i in range(24))
    texts = {1: "00", 2: "0 the 0\n1 the 1\n 22 \n   \n\n5", 3: "  the two  cells  \n  1  \nthe a  b 2\n\tthe tab\t\r\n", 4: numbers, 5: "", 6: " \n", 7: None, 8: "0\n1\n2\n3"}
    pq.write_table(pa.table({"doc_id": list(texts), "text": list(texts.values())}), f"{tmp_path}/documents.parquet")
    got = plans.queries()["document_sections"](spark, str(tmp_path))
    want = [(k, i, x) for k, t in texts.items() for i, x in enumerate(x for x in (x.strip(" ") for x in (t or "").split("\n")) if x)]
    assert sorted(map(tuple, got.collect())) == want
    for name in ("document_sections", "document_search", "document_tables"):
        assert oracle.difference(plans.queries()[name](spark, str(tmp_path)), str(tmp_path), plans.oracle_sql()[name]) is None

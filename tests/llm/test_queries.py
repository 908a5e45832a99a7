import pytest

import __spark_entry__ as entry
from oracle import compare, connect


@pytest.mark.parametrize("name", ["op2_warc_archive", "op4_chat_format", "op9_url_cascade", "op11_spelling_forms", "op12_vector_codes", "op13_top_inner_products"])
def test_same_rows_as_sql(spark, sf, name):
    ok, text = compare(spark, connect(sf), sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()

"""Queries and SQL where photos share a path, as their names do from order key 100 000 on."""

import os

import pytest
from compare import duck, rows

from fotoquarry.plans import registry

NAMES = "artefact_worklist first_sidecar media_records restore_batch restore_counts restore_pairs restore_photos restore_tags sidecar_counts sidecar_plan streamed_index_diff streamed_listing_changes".split()


@pytest.fixture(scope="module")
def shared(sf_dir, tmp_path_factory):
    """The tables, with three photos of one name (DSC and the first five digits) or two (WA and the last four) for every order and its lines."""
    top = tmp_path_factory.mktemp("shared")
    con = duck(sf_dir)
    keys = "SELECT o_orderkey AS old, n.v[1] AS key, n.v[2] AS plus FROM orders, (SELECT unnest([[10005, 0], [100053, 0], [100059, 1], [20000, 0], [50000, 1]]) AS v) n"
    new = f"(SELECT old, CASE WHEN key < 20000 OR key > 100000 THEN key + 6 * old * CASE WHEN key > 100000 THEN 10 ELSE 1 END ELSE key + 6 * (old % 1500) END AS key, plus FROM ({keys}))"
    con.sql(f"CREATE TABLE m AS SELECT DISTINCT ON (key) * FROM {new} ORDER BY key, old")
    con.sql("CREATE TABLE o AS SELECT o.* REPLACE (key AS o_orderkey, o_totalprice + plus AS o_totalprice) FROM orders o JOIN m ON old = o_orderkey")
    con.sql("CREATE TABLE l AS SELECT l.* REPLACE (key AS l_orderkey) FROM lineitem l JOIN m ON old = l_orderkey WHERE (l_linenumber + plus) % 2 = 0")
    for t in os.listdir(sf_dir):
        if t == "orders.parquet":
            con.sql(f"COPY o TO '{top}/{t}' (FORMAT parquet)")
        elif t == "lineitem.parquet":
            con.sql(f"COPY l TO '{top}/{t}' (FORMAT parquet)")
        else:
            os.symlink(f"{sf_dir}/{t}", top / t)
    return str(top)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_where_paths_repeat(spark, shared, name):
    con = duck(shared)
    assert len(con.sql(f"SELECT path FROM ({registry.ORACLES['index_diff']}) GROUP BY path HAVING count(*) > 1 LIMIT 1").df()) == 1
    assert rows(registry.QUERIES[name](spark, shared).toPandas()) == rows(con.sql(registry.ORACLES[name]).df())

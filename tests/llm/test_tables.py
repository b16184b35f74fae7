"""Every query of the training-data operators on empty tables and on tables with clashing columns."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohortlake.llm.queries import QUERIES

CLASHING = "id value u v w a b c part root vertex near key kind node parent n k rank size item container tokens token word code score copy uses rate low high goal share person cell tree n_tokens".split()
FIRST = ["p1_found", "p2_found", "p4_found", "p5_found", "p6_found", "p7_packs", "p8_mix", "p9_found"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory, sf):
    empty, clash = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("clash")
    for p in glob.glob(f"{sf}/*.parquet"):
        t, name = pq.read_table(p), os.path.basename(p)
        pq.write_table(t.slice(0, 0), empty / name)
        for c in CLASHING:
            if c not in t.column_names:
                t = t.append_column(c, pa.array([f"junk{i}" for i in range(t.num_rows)]))
        pq.write_table(t, clash / name)
    return str(empty), str(clash)


@pytest.mark.parametrize("name", FIRST)
def test_empty_tables_give_no_rows(spark, tables, name):
    assert QUERIES[name](spark, tables[0]).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p8_mix", "p9_found"])
def test_clashing_columns_change_nothing(spark, tables, sf, name):
    rows = lambda d: sorted(map(str, QUERIES[name](spark, d).collect()))
    assert rows(tables[1]) == rows(sf)

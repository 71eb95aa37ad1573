"""Every report against the same question put to DuckDB."""

import duckdb
import pandas as pd
import pytest

from sequora import catalog
from sequora.plans import procedures, reports

SF = "/root/testdata/sf0.001"


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        frame[c] = frame[c].astype(float).round(6) if frame[c].dtype.kind in "fiu" else frame[c].astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier", "nation", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(reports.REPORTS) | set(procedures.QUERIES)))
def test_report(spark, duck, name):
    if name not in catalog.ORACLE_SQL:
        pytest.skip("no SQL for it")
    mine = catalog.QUERIES[name](spark, SF)
    pd.testing.assert_frame_equal(plain(mine.toPandas()), plain(duck.execute(catalog.ORACLE_SQL[name]).df()))


def test_empty_ledger(spark, tmp_path):
    for t in ("lineitem", "orders", "customer", "supplier", "nation", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("rotation_islands", "motif_geometry_counts", "entity_features", "enrichment_pairs"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0

"""A choice of registered queries against their SQL on the smallest tables; the import without llm."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidewatch.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
CHOICE = ["early_warning", "threshold_train_fold", "causal_features", "neighbor_lag_mean", "population_cascade", "fold_ledger_rolling", "roc_auc", "reliability_quantile", "lead_time", "threshold_grid", "posterior_risk", "leading_by_cases", "leading_by_rows", "leading_rows"]


def value(x):
    import pandas as pd

    return "" if pd.isna(x) else str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)[:10]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CHOICE)
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "part"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = c.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (sorted([value(x) for x in row] for row in df[columns].astype(object).values.tolist()) for df in (got, want))
    assert a == b


def test_entry_imports_without_the_text_operators(tmp_path):
    root = Path(__file__).parent.parent
    for x in root.iterdir():
        if x.name not in ("tidewatch", ".git", "corpus_pipeline.py", "tests"):
            (tmp_path / x.name).symlink_to(x)
    (tmp_path / "tidewatch").mkdir()
    for x in (root / "tidewatch").iterdir():
        if x.name != "llm":
            (tmp_path / "tidewatch" / x.name).symlink_to(x)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'early_warning' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=60)

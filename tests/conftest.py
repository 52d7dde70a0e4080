import numbers
import os
import sys

import numpy as np
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gneiss.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session(4, **{"spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": f"{shared}/warehouse"})
    s.sparkContext.setCheckpointDir(f"file://{shared}/checkpoint")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf0.001/{name}.parquet'")
    return c


@pytest.fixture(scope="session")
def same(duck):
    """Compare a Spark result with a SQL string's, order apart, floats to 6 places."""

    def plain(df):
        df = df[sorted(df.columns)]
        number = lambda v: isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_))
        clean = lambda v: None if pd.isna(v) else round(float(v), 6) if number(v) else str(v)
        return sorted((tuple(clean(v) for v in row) for row in df.astype(object).itertuples(index=False, name=None)), key=str)

    def check(df, sql):
        a, b = df.toPandas(), duck.sql(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        assert plain(a) == plain(b)

    return check

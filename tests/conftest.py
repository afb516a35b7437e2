import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from kindred.session import session

    s = session(
        "tests", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def comparable(frame):
    """Rows in an order of their own, columns by name, numbers rounded."""
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        kind = str(frame[c].dtype)
        if kind.startswith(("int", "float", "uint", "bool")):
            frame[c] = frame[c].astype(float).round(6)
        else:
            frame[c] = frame[c].map(lambda x: "null" if x is None or x != x else str(x))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def agrees():
    def check(got, want):
        got, want = comparable(got), comparable(want)
        assert list(got.columns) == list(want.columns)
        assert len(got) == len(want)
        assert got.equals(want), (got[(got != want).any(axis=1)].head(), want[(got != want).any(axis=1)].head())

    return check

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from tarnfield.session import session

    folder = tempfile.mkdtemp(prefix="spark-tests-")
    s = session("tests", **{
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.local.dir": f"{folder}/local",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples, floats rounded."""

    def get(df, *cols):
        got = (df.select(*cols) if cols else df).collect()
        return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got), key=repr)

    return get

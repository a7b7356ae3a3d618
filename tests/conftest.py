import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from fringeframe.session import build_session

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    options = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "3g",
        "spark.local.dir": scratch,
        "spark.sql.warehouse.dir": f"{scratch}/warehouse",
        "spark.checkpoint.dir": f"file://{scratch}/checkpoints",
    }
    session = build_session("tests", "local[4]", **{k.replace(".", "__"): v for k, v in options.items()})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

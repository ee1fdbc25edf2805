import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])  # for the Python workers
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from spotflow.session import clear_staging, get_session

    session = get_session("tests", cores="4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_staging(session)
    session.stop()

import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import tessera  # noqa: E402
from tessera.session import local_session  # noqa: E402

cloudpickle.register_pickle_by_value(tessera)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

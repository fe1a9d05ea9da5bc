import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from landloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(2, "landloom-tests", "4g")
    # Tiny inputs: plan and compile as little as possible.
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    session.sparkContext.setLogLevel("OFF")
    if not session.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    yield session
    session.stop()

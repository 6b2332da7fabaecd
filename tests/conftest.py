import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from depsieve import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        8, app="tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "8g"}
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def make_files(spark):
    """package_files from (path, content) pairs or (package, version, path, content) rows."""

    def make(*rows):
        full = [r if len(r) == 4 else ("p", "1.0.0", *r) for r in rows]
        return spark.createDataFrame(
            [(*r, None) for r in full],
            "package STRING, version STRING, path STRING, content STRING, content_error STRING",
        )

    return make

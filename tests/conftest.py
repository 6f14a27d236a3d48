import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusmill.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session(master="local[*]", shuffle_partitions=4, app="corpusmill-tests",
                    extra={"spark.default.parallelism": "4"})
    yield s

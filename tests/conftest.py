from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from depsight.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    s = session("local[4]", 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from panelkit.session import get_spark
    s = get_spark("local[4]", app="panelkit-tests", shuffle_partitions=8,
                  extra={"spark.driver.memory": "8g"})
    yield s

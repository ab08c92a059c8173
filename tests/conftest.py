import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from postlytics.session import get_spark

    s = get_spark("local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def pre_small(spark):
    from postlytics.plans.registry import prepared

    return prepared(spark, SF_SMALL)

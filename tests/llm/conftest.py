import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest


@pytest.fixture(autouse=True)
def shipped(spark):
    from linkweave.llm.tables import ship_package

    ship_package(spark)

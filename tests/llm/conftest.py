from __future__ import annotations

import pytest

from tessera.llm import common

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return common.table(spark, SMALL, "documents")

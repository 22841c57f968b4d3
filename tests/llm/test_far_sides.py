"""Plans for tables that are too large to broadcast give the same rows."""

import pytest

from graphloom.llm import pii, simhash
from graphloom.llm.queries import QUERIES
from tests.conftest import DATA


@pytest.mark.parametrize("name, module, constant", [("op4_pii", pii, "BROADCAST_TERMS"), ("op10_simhash", simhash, "BROADCAST_KEYS")])
def test_nothing_is_broadcast(spark, monkeypatch, name, module, constant):
    want = sorted(map(tuple, QUERIES[name](spark, str(DATA)).collect()))
    monkeypatch.setattr(module, constant, -1)
    assert sorted(map(tuple, QUERIES[name](spark, str(DATA)).collect())) == want

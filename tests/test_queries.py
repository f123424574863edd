"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check_oracles import compare, connect  # noqa: E402

from seedview.plans.oracles import ORACLES  # noqa: E402
from seedview.plans.queries import QUERIES  # noqa: E402

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(ROOT).is_dir(), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"protocol_a", "protocol_b"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, ROOT).toPandas(), con.execute(ORACLES[name]).df()) == "ok"

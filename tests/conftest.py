import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from seedview.session import build_session  # noqa: E402

SKEW_KEYS = ("", ".minRows", ".fair", ".slices", ".grid")
SKEW_MODES = {
    "plain": ("never",),
    "sliced": ("always", "2", "1000000", "4", "0"),
    "grid": ("always", "2", "1000000", "4", "1000"),
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark_ui_enabled="false",
        spark_sql_shuffle_partitions="4",
        spark_driver_memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(params=list(SKEW_MODES))
def skew_mode(request, spark):
    """Runs a test with plain windows, with every group cut into slices, and with rows merged
    between seeds before that."""
    for key, value in zip(SKEW_KEYS, SKEW_MODES[request.param]):
        spark.conf.set(f"seedview.skew{key}", value)
    yield request.param
    for key in SKEW_KEYS:
        spark.conf.unset(f"seedview.skew{key}")


@pytest.fixture(autouse=True)
def small_inputs(request, spark):
    """In-memory frames have unknown size, which counts as large; most tests want plain plans."""
    if "skew_mode" in request.fixturenames:
        yield
        return
    spark.conf.set("seedview.skew", "never")
    yield
    spark.conf.unset("seedview.skew")

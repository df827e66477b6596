import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from oracle import make_spark

    session = make_spark()
    yield session
    session.stop()


@pytest.fixture
def small_blocks(spark):
    """Layouts with many blocks, as for recordings too long for one task."""
    names = ("spark.saccadia.rowsPerBlock", "spark.saccadia.valuesPerCell")
    for n in names:
        spark.conf.set(n, "5")
    yield
    for n in names:
        spark.conf.unset(n)


@pytest.fixture
def make_samples(spark):
    """Samples of one or more recordings from rows of dicts."""
    from saccadia.schema import SAMPLES

    def make(rows, recording="r1"):
        full = []
        for k, row in enumerate(rows):
            given = {"recording_id": recording, "sample_seq": k, "valid": True, **row}
            full.append(tuple(given.get(f.name) for f in SAMPLES.fields))
        return spark.createDataFrame(full, SAMPLES)

    return make

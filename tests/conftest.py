from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from helpdesk_lake.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.01"
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[4]", app_name="helpdesk-lake-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def model(spark):
    from helpdesk_lake.sources.fixtures import fixture_model

    return fixture_model(spark, SF)

"""Registered queries that cut hot devices, with every device taken for a hot one."""

import pytest

from hydrolens.plans.oracle import ORACLE
from hydrolens.plans.queries import BATCH
from tests.compare import compare, duck
from tests.conftest import SF_DIR

# Rows of a device from which it is cut.
SMALL_SLICE = 16
SLICED = (
    "reading_gaps", "ph_ma10", "calibrated_ph_asof", "calibration_requests", "config_asof",
    "config_asof_nulls", "pump_actions", "pump_timeline", "offline_spans",
)


@pytest.mark.parametrize("name", SLICED)
def test_slices_give_the_same(spark, name):
    found = BATCH[name](spark, SF_DIR, rows_per_slice=SMALL_SLICE)
    assert compare(found, duck(SF_DIR), ORACLE[name]) is None

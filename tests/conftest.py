import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from folio.session import get_spark

    s = get_spark("local[4]", shuffle_partitions=8, app="folio-tests")
    yield s


@pytest.fixture(scope="session")
def sf_small():
    if not os.path.isdir(SF_SMALL):
        pytest.skip("test tables not available")
    return SF_SMALL


def rows(df, *cols):
    """Collect selected columns as a list of tuples (small test frames only)."""
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


@pytest.fixture(autouse=True)
def _ship_test_module_by_value(request):
    """Functions and classes defined in a test module reach the Python workers by value."""
    try:
        from pyspark import cloudpickle

        if request.module.__name__ in sys.modules:
            cloudpickle.register_pickle_by_value(request.module)
    except Exception:
        pass

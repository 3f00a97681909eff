import pytest

from spanloom.runtime import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", cpus=4, **{"spark.driver.memory": "3g"})
    yield s

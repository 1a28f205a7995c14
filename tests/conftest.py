import pytest

from strandline.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[3]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

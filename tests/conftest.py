import pytest

from treillis.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    # Tiny inputs: interpreting a plan is faster than compiling it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    return session

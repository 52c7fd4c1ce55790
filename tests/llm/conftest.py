import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("shared"))

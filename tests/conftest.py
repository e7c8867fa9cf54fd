import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyfold.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    """Write small files and give their folder: ``folder(name=text, ...)``."""

    def write(**files):
        for name, text in files.items():
            data = text if isinstance(text, bytes) else text.encode()
            (tmp_path / f"{name}.txt").write_bytes(data)
        return str(tmp_path)

    return write


@pytest.fixture
def out(tmp_path_factory):
    return str(tmp_path_factory.mktemp("out") / "result")


@pytest.fixture
def lines(spark):
    """Lines of a result folder in part-file order."""

    def read(path):
        text = []
        for name in sorted(os.listdir(path)):
            if name.startswith("part-"):
                with open(os.path.join(path, name), encoding="utf-8") as part:
                    text += part.read().split("\n")[:-1]
        return text

    return read

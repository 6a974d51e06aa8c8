import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check_oracles import connect, session  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def folder():
    return TABLES


@pytest.fixture(scope="session")
def duck(folder):
    return connect(folder)


@pytest.fixture()
def write(tmp_path):
    """Write {relative name: text or bytes} below a new folder and return the folder."""

    def writer(files, name="docs"):
        root = tmp_path / name
        root.mkdir(exist_ok=True)
        for relative, content in files.items():
            path = root / relative
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
        return str(root)

    return writer

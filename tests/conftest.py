import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
for path in (ROOT, ROOT / "tests"):
    if str(path) not in sys.path:
        sys.path.insert(0, str(path))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerline.session import build_session

    session = build_session(
        "local[8]",
        app="ledgerline-tests",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__sql__shuffle__partitions=4,
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    from ledgerline.sources.warehouse import star_warehouse

    return star_warehouse(spark, SF_DIR)

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pathlode.functions.paths import with_parts  # noqa: E402
from pathlode.schema import ENTRY  # noqa: E402
from pathlode.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        8,
        **{
            "spark.checkpoint.dir": str(shared),
            "spark.sql.shuffle.partitions": "3",
            "spark.default.parallelism": "2",
            "spark.sql.maxMetadataStringLength": "10000",
            "spark.sql.warehouse.dir": str(shared / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def entries(spark):
    """Build entries from paths; a path ending in ``/`` is a directory."""

    def build(*paths, size=0, modified=0):
        rows = []
        for p in paths:
            path, *rest = p if isinstance(p, tuple) else (p,)
            values = (rest + [size, modified, 0, 0][len(rest) :])[:4]
            rows.append((path.rstrip("/"), path.endswith("/"), *values))
        return with_parts(spark.createDataFrame(rows, ENTRY))

    return build


@pytest.fixture(scope="session")
def depot(entries):
    """A directory in a directory, one name in two spellings, a double and a missing extension."""
    return entries(
        "/store/",
        ("/store/Plan A.ods", 640),
        ("/store/seeds-2024.csv", 90_000),
        ("/store/seeds-2024.csv.gz", 7_000),
        "/store/Old/",
        ("/store/Old/Seeds.CSV", 1),
        "/post/in.mbox",
        "/post/NOTICE",
        "/post/draft_one.eml",
    )


def names(df):
    return sorted(r["name"] for r in df.select("name").collect())


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from forgelens.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("tests", "local[4]")


@pytest.fixture(scope="session")
def make_files(spark):
    """files table from (path, content) or (repo, path, content) tuples."""

    def build(rows):
        full = [("r", *row) if len(row) == 2 else row for row in rows]
        return spark.createDataFrame(
            [(repo, path, "blob", len(c or ""), c) for repo, path, c in full],
            "repo string, path string, kind string, size_bytes bigint, content string",
        )

    return build


@pytest.fixture(scope="session")
def repos_of(spark):
    def build(*names):
        return spark.createDataFrame(
            [(n, "main", 1, "Python") for n in names],
            "repo string, default_branch string, stars int, language string",
        )

    return build

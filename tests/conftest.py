from __future__ import annotations

import pytest

from vitrine.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("vitrine-tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    return session


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


def rows(frame, *columns):
    """Rows as a sorted list of plain tuples."""
    chosen = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in chosen.collect()), key=str)


@pytest.fixture(scope="session")
def as_rows():
    return rows

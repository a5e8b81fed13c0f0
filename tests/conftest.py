from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join((ROOT, os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")))  # tests name models of their own


@pytest.fixture(scope="session")
def spark():
    from normloom.session import local_session

    return local_session(4, "3g", 4)


@pytest.fixture(scope="session")
def small():
    """The smallest test tables."""
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path

"""Every core query with SQL gives the same rows on the smallest test archive."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_queries_equal_their_sql():
    from compare import main

    from talklake.plans import registry

    assert main(FOLDER, list(registry.SQL)) == 0

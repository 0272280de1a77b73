"""p3_found against every pair compared, on the smallest test archive."""

import itertools
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import duck, session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_p3_found_equals_all_pairs():
    from talklake.llm.queries import p3_found

    rows = duck(FOLDER).execute("select id, content from (select id, content, row_number() over (partition by id order by updated_at::timestamptz desc) r from messages) where r = 1").fetchall()
    sets = [(i, frozenset(re.findall(r"[^\W_]+", (t or "").lower()))) for i, t in rows]
    sets = [x for x in sets if len(x[1]) >= 20]
    want = set()
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if 10 * len(a & b) >= 7 * len(a | b):
            want.add(tuple(sorted((i, j), key=int)))
    got = [tuple(r) for r in p3_found(session(4), FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want

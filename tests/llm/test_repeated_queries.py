from collections import Counter

import numpy as np
import pytest

from textlake.llm import ann
from test_scan_search_language import exact, vectors


@pytest.mark.parametrize("equal", [True, False])
@pytest.mark.parametrize("block", [32_768, 40])
def test_rows_that_repeat_a_query_id_have_a_list_each(spark, equal, block):
    x = np.random.default_rng(4).normal(size=(120, 8))
    ids = list(range(119)) + [20]
    if equal:
        x[119] = x[20]
    want = Counter()
    for row in (20, 119):
        others = [i for i in range(120) if i not in (20, 119)]
        found = exact(np.concatenate([x[[row]], x[others]]), np.array([20] + [ids[i] for i in others]))[20]
        want.update((rank, i, s) for rank, (i, s) in enumerate(found, 1))
    got = ann.nearest(vectors(spark, x, ids), block=block).collect()
    assert Counter((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 20) == want
    assert all(n == 20 for q, n in Counter(r.query_id for r in got).items() if q != 20)

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taleloom.llm.cqf import CountingQuotientFilter
from taleloom.llm.exact_dedup import exact_duplicates


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 20), st.integers(2**64 - 20, 2**64 - 1)), max_size=200), st.integers(1, 5))
def test_filters_merge_without_loss(values, parts):
    values = np.array(values, dtype=np.uint64)
    filters = [CountingQuotientFilter.loads(CountingQuotientFilter.of(values[i::parts]).dumps()) for i in range(parts)]
    fps, counts = CountingQuotientFilter.merged(filters).items()
    want = np.unique(values, return_counts=True)
    assert fps.tolist() == want[0].tolist() and counts.tolist() == want[1].tolist()


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm, strict=True):
        groups.setdefault(n, []).append(i)
    least = {n: min((i for i in g if i is not None), default=None) for n, g in groups.items()}
    return sorted(((i, least[n], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm, strict=True)), key=str), groups, least


@pytest.mark.parametrize("rows", [
    [],
    [(1, "a b"), (2, "a  b"), (3, "a b"), (4, None), (5, ""), (6, " "), (7, "\t\n"), (8, "x" * 300_000), (9, "x" * 300_000), (10, "A b")],
    [(2, "same"), (2, "same"), (2, "other"), (None, "same"), (None, "alone"), (None, "alone"), (1, "same")],
])
def test_groups_match_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, fp string, copies int, norm string")
    got = exact_duplicates(docs).collect()
    want, groups, least = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups)
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(x) for x in least.values())

"""Every overlap that the 80 % rule counts is found, whichever words are substituted."""

import itertools

import pyarrow as pa
import pytest
from corvane.llm import decontaminate


@pytest.mark.parametrize("n", [5, 6, 9, 10, 11, 12, 13, 15, 16, 17, 18, 20, 21])
def test_any_fifth_of_the_words_may_be_substituted(n):
    item = [f"w{k}" for k in range(n)]
    patterns = list(itertools.combinations(range(n), n // 5))
    texts = ["before it " + " ".join("other" if k in bad else w for k, w in enumerate(item)) + " after" for bad in patterns]
    items = decontaminate.Items([1], pa.array([" ".join(item)]))
    found = decontaminate.overlaps(items, *decontaminate.words(pa.array(texts)))
    assert {r for r, *_ in found} == set(range(len(texts)))


@pytest.mark.parametrize("n", [5, 6, 9, 10, 11])
def test_one_more_is_too_many_for_short_items(n):
    item = [f"w{k}" for k in range(n)]
    texts = [" ".join("other" if k in bad else w for k, w in enumerate(item)) for bad in itertools.combinations(range(n), n // 5 + 1)]
    items = decontaminate.Items([1], pa.array([" ".join(item)]))
    texts += [" ".join(item[1:]), " ".join(item[:-1])]
    assert not decontaminate.overlaps(items, *decontaminate.words(pa.array(texts)))

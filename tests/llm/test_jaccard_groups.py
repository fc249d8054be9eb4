"""Large groups in the Jaccard join: near copies around an outlier, and texts that are just not similar enough."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import jaccard_join


def replaced(rng, base, n):
    """base with n words, ten places apart or more, replaced by new ones."""
    out = list(base)
    for at in rng.permutation(len(base) // 10)[:n] * 10 + rng.integers(0, 10, n):
        out[at] = "".join(rng.choice(list("abcdefghijklm"), 9))
    return out


def plain_components(texts, words, percent):
    """component of each text, over all pairs, by a matrix of shared shingles."""
    sets = [{tuple(x[i : i + words]) for i in range(len(x) - words + 1)} for x in texts]
    number = {}
    held = np.zeros((len(sets), sum(map(len, sets))), np.float32)
    for i, s in enumerate(sets):
        held[i, [number.setdefault(t, len(number)) for t in s]] = 1
    held = held[:, : len(number)]
    same, size = held @ held.T, held.sum(axis=1)
    linked = 100 * same >= percent * (size[:, None] + size[None, :] - same)
    out = list(range(len(sets)))
    for i in range(len(sets)):
        if out[i] == i:
            todo = [i]
            while todo:
                for j in np.flatnonzero(linked[todo.pop()]).tolist():
                    if out[j] != i:
                        out[j] = i
                        todo.append(j)
    return out


@pytest.fixture(scope="module")
def group():
    """An outlier with the smallest id, which is every star's first hub, and 300 texts, each a word away from a base."""
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(140)]
    return [replaced(rng, base, 8)] + [replaced(rng, base, 1) for _ in range(300)]


def test_further_stars_join_a_group_whose_hub_is_an_outlier(spark, group):
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(group)], "id bigint, text string")
    sizes = rows.mapInArrow(jaccard_join._profile(4, 8), "id bigint, n bigint, h1 bigint, h2 bigint, low array<bigint>")
    keyed = sizes.select(F.col("id").alias("rep"), "n", F.explode("low").alias("low"))
    none = spark.createDataFrame([], "a bigint, b bigint")
    links, found = jaccard_join.linked_further(rows, keyed, none, 4, 85, 12)
    component = {r.node: r.component for r in found.collect()}
    # The outlier has no link; of the others hardly any is left alone, by few pairs.
    assert 0 not in component
    assert sum(component.get(i) == 1 for i in range(1, 301)) >= 290
    assert links.count() < 8 * 300


def test_a_group_around_an_outlier_is_whole(spark, group):
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(group)], "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
    want = plain_components(group, 4, 85)
    assert got == dict(enumerate(want)) and want[0] == 0 and want[2:] == want[1:-1]


def test_a_group_that_is_nearly_similar_enough(spark):
    """400 texts at similarities of some 70 to 95 %: links and near misses mixed."""
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(140)]
    texts = [replaced(rng, base, int(n)) for n in rng.choice([1, 2, 3, 4], 400, p=[0.02, 0.28, 0.4, 0.3])]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    want = plain_components(texts, 4, 85)
    assert 10 < len(set(want)) < 390
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()} == dict(enumerate(want))

"""Toxicity: neighbours against brute force, held-out labels, awkward rows."""

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import toxicity

SCHEMA = "doc_id bigint, text string, id string, term string, y string"


def test_neighbours_are_exact():
    """Against all products, ties included; blocks whose bound is too small aren't read."""
    rng = np.random.default_rng(8)
    n_terms, vectors = 40, []
    for _ in range(700):
        terms = np.sort(rng.choice(n_terms, int(rng.integers(1, 6)), replace=False))
        w = rng.integers(1, 4, len(terms)).astype(float)
        vectors.append((terms, w / np.sqrt((w * w).sum())))
    vectors.sort(key=lambda v: (int(v[0][v[1].argmax()]), -v[1].max()))
    index, dense = toxicity.BlockMaxIndex(vectors, n_terms), np.zeros((700, n_terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    read = 0
    for t, w in vectors[::7]:
        rows, cosine, blocks = index.nearest(t, w, 20)
        want = dense[:, t] @ w
        order = [i for i in np.lexsort((np.arange(700), -np.round(want, 12))) if want[i] > 0][:20]
        assert np.allclose(want[rows], cosine) and np.allclose(np.sort(want[order]), np.sort(cosine))
        read += blocks
    assert read < 0.9 * index.blocks * len(vectors[::7])


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    stems = ["scoundrel", "nitwit", "buffoon"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(int(rng.integers(20, 80)))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(int(rng.integers(0, len(words))), stems[int(rng.integers(0, 3))] + ["", "s", "ish", "ly"][int(rng.integers(0, 4))])
        rows.append((i, " ".join(words).capitalize(), "x", "y", "z"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_and_awkward_rows(spark):
    rows, labels = corpus(400, 1)
    docs = spark.createDataFrame([*rows, (None, rows[0][1], "", "", ""), (7, rows[7][1], "", "", ""), (900, None, "", "", ""), (901, "", "", "", ""), (902, "12 + !", "", "", ""), (903, "nitwits " * 20_000, "", "", "")], SCHEMA).repartition(3)
    known = spark.createDataFrame([*labels[:300], (5, 0), (None, 1), (6, None), (8, 7)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, known)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 406 and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert all((score[i] >= 0.7) == bool(y) for i, y in labels[300:])
    assert {score[i] for i in (900, 901, 902)} == {model["base"]} and model["base"] < 0.05 and score[903] >= 0.7
    assert next(r.score for r in got if r.doc_id is None) == score[0] and [r.nearest for r in got if r.doc_id == 901] == [[]]
    toxic = {i for i, y in labels[:300] if y}
    assert all(set(r.nearest) <= toxic and len(r.nearest) == 3 for r in got if r.doc_id in (300, 305, 310))


def test_sample_keeps_shares(spark):
    """With few examples of each label the votes still have the shares of all labelled rows."""
    rows, labels = corpus(300, 2)
    model = toxicity.train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int"), max_rows=30)
    assert model["share"] == pytest.approx(0.2) and set(model["votes"].tolist()) <= {2.0, 8.0} and len(model["ids"]) <= 60


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(1, 1), (1, 0)]])
def test_one_label_or_none(spark, labels):
    docs = spark.createDataFrame([(1, "a b c", "", "", ""), (2, None, "", "", ""), (2, "b c", "", "", "")], SCHEMA)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    want = {0: 0.5, 1: 1.0, 2: 0.0 if labels and labels[0][1] == 0 else 0.5}[len(labels)]
    assert [r.score for r in toxicity.score(docs, model).collect()] == [want] * 3
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_terms():
    """Words of letters with their first bytes; prefixes never count as words."""
    text = pa.array(["Réeuxment!! a2b", None, "réeux"])
    _, buf, offsets = next(toxicity.text_chunks(text))
    at, term, words = toxicity._terms(buf, offsets)
    assert words.tolist() == [3, 0, 1] and np.bincount(at, minlength=3).tolist() == [3 + 4, 0, 1 + 2]
    assert len(set(term[at == 0]) & set(term[at == 2])) == 2

"""Benchmark decontamination: candidates by cosine in the latent space."""

from __future__ import annotations

import numpy as np
import pytest

from weftgraph.llm import decontaminate


def _words(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(n)]


def test_windows_equal_brute_force():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 40, n) for n in (1, 7, 8, 9, 40, 200, 900, 16)] + [np.zeros(20, np.int64)]
    weights = np.concatenate([[0], rng.random(39) + 0.1])
    basis = rng.standard_normal((40, 5)).astype(np.float32)
    parts = [[rng.integers(1, 40, n)] for n in (3, 16, 17, 24, 40, 70, 130)]
    items = decontaminate.Items(list(range(7)), parts, weights, basis, 0.55)
    scaled = basis * weights[:, None].astype(np.float32)
    got = {(t, i, at): (width, cosine) for t, i, at, width, cosine in decontaminate.latent_windows(texts, scaled, items, 0.3)}
    wanted = {}
    for i, (item,) in enumerate(parts):
        width = next(n for n in (16, 24, 32, 48, 64, 96, 128, 192) if n >= len(item))
        y = weights[item] @ basis[item]
        for t, text in enumerate(texts):
            for at in range(0, len(text), max(8, width // 4 // 8 * 8)):
                if at == 0 or at + width < -(-len(text) // 8) * 8 + max(8, width // 4 // 8 * 8):
                    x = weights[text[at : at + width]] @ basis[text[at : at + width]]
                    wanted[t, i, at] = (width, float(x @ y / max(1e-12, np.linalg.norm(x) * np.linalg.norm(y))))
    assert {k for k, v in wanted.items() if v[1] >= 0.3001} <= set(got) <= {k for k, v in wanted.items() if v[1] >= 0.2999}
    assert len(got) > 50 and all(got[k][0] == wanted[k][0] and got[k][1] == pytest.approx(wanted[k][1], abs=1e-4) for k in got)


def test_small_pieces_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 40, n) for n in (900, 3, 500, 70)]
    weights, basis = np.concatenate([[0], rng.random(39) + 0.1]), rng.standard_normal((40, 5)).astype(np.float32)
    items = decontaminate.Items([0, 1], [[rng.integers(1, 40, 20)], [rng.integers(1, 40, 90)]], weights, basis, 0.55)
    found = lambda: sorted(x[:4] for x in decontaminate.latent_windows(texts, basis * weights[:, None].astype(np.float32), items, 0.3))
    whole = found()
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    assert found() == whole and len(whole) > 10
    assert [b for b, _ in decontaminate._groups(texts)] == [0, 1, 2, 3]


def _reworded(spark, replaced: float):  # noqa: ANN001, ANN202
    """40 items between other words, each with that share of its words replaced."""
    rng = np.random.default_rng(7)
    rare, common = _words(8, 4000), ["the", "of", "and", "to", "in", "a"]
    word = lambda: str(rng.choice(common) if rng.random() < 0.3 else rng.choice(rare))
    items = [[word() for _ in range(40)] for _ in range(40)]
    many = lambda n: " ".join(word() for _ in range(n))
    rows = [(1000 + i, many(200)) for i in range(400)]
    rows += [(i, f"{many(60)} {' '.join(word() if rng.random() < replaced else w for w in x)} {many(60)}") for i, x in enumerate(items)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    return spark.createDataFrame(rows, "doc_id bigint, text string"), bench


def test_the_latent_space_finds_what_rare_words_do_not(spark, monkeypatch):
    docs, bench = _reworded(spark, 0.4)
    pairs = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert all(d == i for d, i in pairs) and len(pairs) >= 36
    whole = decontaminate.latent_basis
    monkeypatch.setattr(decontaminate, "latent_basis", lambda *args: whole(*args) * 0)
    without = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert without < pairs


def test_blocks_repeated_rows_and_clashing_names(spark, monkeypatch):
    """Items in blocks of two, an item twice, rows twice, columns called like those that the operator makes."""
    words = _words(9, 900)
    items = [" ".join(words[40 * i : 40 * i + 40]) for i in range(5)]
    rows = [(i, f"{' '.join(words[300 + 60 * i : 340 + 60 * i])} {x}", 1, "c") for i, x in enumerate(items)] * 2
    rows += [(None, items[0], 1, "c"), (20, None, 1, "c"), (21, "", 1, "c"), (22, " ".join(words[600:900]), 1, "c")]
    docs = spark.createDataFrame(rows, "id bigint, words string, item_id int, cosine string")
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (7, "."), (8, None)], "key bigint, lcs string")
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    got = decontaminate.contaminated(docs, bench, id_col="id", text_col="words", item_col="key", item_text_col="lcs")
    assert got.columns == ["id", "key", "cosine", "lcs", "first_word"]
    assert sorted((r.id, r.key) for r in got.collect()) == [(i, i) for i in range(5)]
    assert decontaminate.contaminated(docs.where("false"), bench, id_col="id", text_col="words", item_col="key", item_text_col="lcs").count() == 0

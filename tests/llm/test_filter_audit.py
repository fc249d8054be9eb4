"""The filter audit against brute force on awkward rows, and its tries by themselves."""

import re
from itertools import permutations

import numpy as np
import pytest

from weftgraph.llm import filter_audit

PROSE = " ".join(f"w{i}" for i in range(210))
TEXTS = [None, "", " \t\n", "a", PROSE, PROSE, PROSE + " #", PROSE.upper(), "x " * 300, "é😀 " * 250, PROSE[:-1], PROSE + " |", "A" * 20_000, "Ünï " * 90 + "\0", "ab\x1ccd " * 250, PROSE[:40], PROSE[:8]]
SCHEMA = "doc_id bigint, text string, source string, mask string, n string"


def plain(rows, labels):
    """All counts by applying each order to each row."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    judged = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        judged.append((part or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out, removed = {}, {}
    for part in {p for p, *_ in judged}:
        mine = [x for x in judged if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed[part, f] = removed.get((part, f), 0) + len(gone)
                redundant = sum(f in x[1] for x in mine) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("range_texts", [100, 2])
def test_against_brute_force(spark, monkeypatch, range_texts):
    """Columns with clashing names, null and repeated ids, null parts; with small chunks and ranges every prefix level is used."""
    if range_texts == 2:
        monkeypatch.setattr(filter_audit, "CHUNK", 1)
    rng = np.random.default_rng(3)
    rows = [(int(i), TEXTS[int(rng.integers(0, len(TEXTS)))], [None, "", "a", "b"][int(rng.integers(0, 4))]) for i in rng.permutation(120)]
    rows += [(None, PROSE, "a"), (None, PROSE, "a"), (3, rows[0][1], "b"), (3, rows[0][1], "b"), (500, "only", "c")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 130, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    known = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id bigint, quality int, toxic int, text string")
    got = filter_audit.audit(docs, known, range_texts=range_texts).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}
    assert found == plain(rows, labels) and len(got) == len(found)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, PROSE, None, "", "")], SCHEMA)
    rows = filter_audit.audit(one, labels).collect()
    assert len(rows) == 600 and {tuple(r)[3:] for r in rows} == {(1, 0, 0, 0, 0, 0, 0)}


def test_trie_holds_least_ids():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, int(rng.integers(0, 9))).astype(np.uint8)) for _ in range(400)]
    trie = filter_audit.Trie()
    ends = [trie.insert(t, i) for i, t in zip(rng.permutation(400).tolist(), texts, strict=True)]
    rng = np.random.default_rng(1)
    again = [bytes(rng.integers(97, 99, int(rng.integers(0, 9))).astype(np.uint8)) for _ in range(400)]
    ids = rng.permutation(400).tolist()
    least = {t: min(i for i, u in zip(ids, again, strict=True) if u == t) for t in again}
    assert [trie.least[n] for n in ends] == [least[t] for t in texts]
    # A node for each text, each place where texts part, and the root.
    assert len(trie.labels) <= 2 * len(set(texts)) + 1

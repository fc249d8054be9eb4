"""Collocations against brute force on awkward rows."""

import re
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import collocations
from weftgraph.llm._text import BASE

SCHEMA = "text string, lang string, w1 string, n string, phrase string"


def plain(rows, least, top, contained):
    """The definition, phrase by phrase."""
    counts, totals = {}, Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words, own = re.findall("[^\x20\x09]+", piece), counts.setdefault("und" if lang is None else lang, Counter())
            totals["und" if lang is None else lang] += len(words)
            own.update(" ".join(words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and " " in p}
        kept = []
        for p, a in found.items():
            w = p.split(" ")
            score, k = min((2_000_000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w)))
            longer = [b for q, b in found.items() if q.count(" ") > p.count(" ") and f" {p} " in f" {q} "]
            if not any(100 * b >= contained * a for b in longer):
                kept.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return out


def got(df, **options):
    return sorted(map(tuple, collocations.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("top", [2000, 7])
def test_against_brute_force(spark, monkeypatch, top):
    """Ties, nulls, repeated rows, long texts, words outside ASCII, every kind of white space; small chunks and full holds."""
    monkeypatch.setattr(collocations, "CHUNK", 200)
    monkeypatch.setattr(collocations, "HELD", 20)
    monkeypatch.setattr(collocations, "SALTS", 3)
    rng = np.random.default_rng(4)
    vocabulary = ["the", "The", "of", "a", "New", "york", "é", "ÉÉ", "x\x1cy", " ", "im", "Haus", "b-c"]
    ends = [" ", " ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", ";x:", "!?"]
    text = lambda n: "".join(vocabulary[min(int(rng.geometric(0.2)) - 1, 12)] + ends[int(rng.integers(0, len(ends)))] for _ in range(n))
    rows = [(text(int(n)), ["en", "de", None, "", "und"][int(rng.integers(0, 5))]) for n in rng.integers(0, 60, 80)]
    rows += [(None, "en"), ("", None), (" \t\n", "fr"), ("new york city " * 400, "en"), ("new york", "en"), ("one two three four five", "xx")] * 2
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(5)
    want = plain(rows, 4, top, 80)
    assert got(df, least=4, top=top) == sorted(want) and len(want) > 20


def test_words_with_equal_hashes_stay_apart(spark):
    """The Thue-Morse word of 1,024 letters and its complement have the same sum of powers, whatever its base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    assert sum(ord(c) * pow(int(BASE), i, 1 << 64) for i, c in enumerate(one)) % (1 << 64) == sum(ord(c) * pow(int(BASE), i, 1 << 64) for i, c in enumerate(two)) % (1 << 64)
    rows = [(f"{one} end", "en")] * 6 + [(f"{two} end", "en")] * 5
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    assert got(df, least=4, contained=101) == sorted(plain(rows, 4, 2000, 101))


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of a table too large to write down."""
    huge = 3_000_000_000_000_000_001
    rows = [("en", 0, [], 2 * huge), ("en", 1, ["a"], huge + 2), ("en", 1, ["b"], huge), ("en", 2, ["a", "b"], huge), ("en", 3, ["a", "b", "c"], huge // 5 * 4), ("en", 1, ["c"], huge // 5 * 4), ("en", 2, ["b", "c"], huge // 5 * 4)]
    counts = spark.createDataFrame(rows, "lang string, size int, words array<string>, f bigint")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: counts)
    found = {r[2]: (r[3], r[7]) for r in got(counts)}
    third = huge // 5 * 4
    assert found == {"a b": (huge, 2_000_000 * huge // (2 * huge + 2)), "a b c": (third, min(2_000_000 * third // (huge + 2 + third), 2_000_000 * third // (huge + third)))}


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(None, None, "", "", ""), ("", "en", "", "", "")], SCHEMA)) == []

"""What op4 holds at once doesn't grow with a shard or a run."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftgraph.llm import suffix_dedup


def passages_between_noise(rng, n):  # noqa: ANN001, ANN201
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passages = [noise(int(n)) for n in rng.integers(110, 400, 6)]
    return ["".join([noise(40), *(x for i in rng.integers(0, len(passages), 3) for x in (passages[i][int(rng.integers(0, 20)) :], noise(40)))]) for _ in range(n)]


def repeated_starts(texts, length=100):  # noqa: ANN001, ANN201
    seen, out = set(), set()
    for i, t in enumerate(texts):
        for j in range(len(t) - length + 1):
            if t[j : j + length] in seen:
                out.add((i, j))
            seen.add(t[j : j + length])
    return out


def test_rows_of_stored_tables_are_small(spark, monkeypatch):
    """Every repeated anchor is hot. Rows with the packed strings of a run, half a megabyte each, filled executors when they were read again by the thousand."""
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    tables, kept = {}, suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: tables.setdefault(len(tables), kept(df, name)))
    texts = passages_between_noise(np.random.default_rng(3), 200)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    assert suffix_dedup.remove_repeats(df).where("n_removed > 0").count() > 150
    assert len(tables) > 3
    for table in tables.values():
        bytes_of = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in table.dtypes if kind == "binary"]
        assert (table.select(F.max(sum(bytes_of, F.lit(0)))).first()[0] or 0) < 5_000, table.columns


def test_suffix_arrays_of_a_shard_are_small(monkeypatch):
    """One shard with many anchors whose segments differ: suffix arrays are over few anchors at a time, and the repeats are those by definition."""
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 4_000, raising=False)
    sizes, classes = [], suffix_dedup._classes
    monkeypatch.setattr(suffix_dedup, "_classes", lambda held, length: sizes.append(sum(map(len, held))) or classes(held, length))
    texts = passages_between_noise(np.random.default_rng(4), 60)
    every, none = (SimpleNamespace(value=np.full(4, v, np.uint64)) for v in (2**64 - 1, 0))
    rows = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], ["id", "text"])
    found = suffix_dedup._shard(100, none)(pa.Table.from_batches(suffix_dedup._segments(100, 1, every, none)(iter([rows]))))
    got = {(i, j) for i, a, b in zip(*(found.column(c).to_pylist() for c in ("id", "first", "last")), strict=True) for j in range(a, b + 1)}
    assert got == repeated_starts(texts) and len(got) > 5_000
    # An anchor has 60 occurrences times three at most here, of 168 bytes at most.
    assert len(sizes) > 3 and max(sizes) <= 4_000 + 180 * 168

"""Stages of the pipeline on rows that repeat, repeated ids and null ids."""

from collections import Counter

import numpy as np

import corpus_pipeline


def words(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(n))


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = (words(i) for i in range(4))
    rows = [(7, a)] * 5 + [(3, a), (None, a), (3, b), (None, c), (None, c), (8, d + " end"), (9, d)]
    rows += [(1, ""), (1, ""), (1, None), (2, ""), (None, ""), (None, ""), (4, " "), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter(map(tuple, corpus_pipeline.near_duplicate_stage(spark, df, "").collect()))
    assert got == Counter([(3, a), (3, b), (None, c), (8, d + " end"), (1, ""), (1, None), (2, ""), (None, ""), (None, ""), (4, " ")])
    assert corpus_pipeline.near_duplicate_stage(spark, df.where("false"), "").count() == 0


def test_leaks_go_by_row(spark, tmp_path):
    item, clean = words(10, 40), words(11)
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = [(1, f"{clean} {item}"), (1, clean), (None, f"{item} {clean}"), (None, clean), (2, None)] + [(10 + i, words(20 + i)) for i in range(30)]
    got = corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), f"file://{tmp_path}").collect()
    assert Counter(map(tuple, got)) == Counter(r for r in rows if item not in (r[1] or ""))


def test_a_column_of_the_user_is_kept(spark, tmp_path):
    """Columns named like the stages' own key come out as they were."""
    item = words(10, 40)
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = [(i, words(30 + i), f"mine {i}", -i) for i in range(6)] + [(9, words(30), "copy", 7), (8, item, "leak", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _ROW string, _row_ int")
    once = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert once.columns == df.columns and Counter(map(tuple, once.collect())) == Counter(r for r in rows if r[2] != "copy")
    clean = corpus_pipeline.decontamination_stage(spark, df, f"file://{tmp_path}")
    assert clean.columns == df.columns and Counter(map(tuple, clean.collect())) == Counter(r for r in rows if r[2] != "leak")


def test_quality_stage_judges_each_row_by_its_text(spark, tmp_path):
    """The model sees the form of texts, not their words: the bad ones are in capitals and between bars."""
    rng = np.random.default_rng(8)
    good, bad = ([words(100 * j + i, 5) for i in range(4)] for j in (1, 2))
    text = lambda kind, by: by.join(rng.choice(kind, 12))
    rows = [(i, text(good, " ") if i % 2 else text(bad, " | ").upper(), i) for i in range(400)]
    spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    more = [(None, rows[1][1], 1), (None, rows[0][1], 2), (3, None, 3), (3, "", 4), (1, rows[1][1], 5), (1, rows[1][1], 5)]
    df = spark.createDataFrame(rows + more, "doc_id bigint, text string, score int")
    out = corpus_pipeline.quality_stage(spark, df, f"file://{tmp_path}")
    got = Counter(map(tuple, out.collect()))
    assert out.columns == df.columns and not got - Counter(rows + more)
    stays = {}
    for r in rows + more:
        stays.setdefault(r[1] or "", set()).add(got[r] > 0)
    assert all(len(s) == 1 for s in stays.values())
    assert got[1, rows[1][1], 5] == 2
    assert sum(got[r] for r in rows[1::2]) >= 190 and sum(got[r] for r in rows[0::2]) <= 20
    assert corpus_pipeline.quality_stage(spark, df.where("false"), f"file://{tmp_path}").count() == 0


def test_personal_data_goes_and_no_row(spark):
    rows = [(1, "write to jane.roe@example.org now", 33, "x"), (1, "write to jane.roe@example.org now", 33, "x"), (None, "plain words", 11, "y"), (2, None, None, "z"), (3, "", 0, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, entity string")
    out = corpus_pipeline.pii_stage(spark, df, "")
    got = out.collect()
    assert out.columns == df.columns and Counter((r.doc_id, r.entity) for r in got) == Counter((r[0], r[3]) for r in rows)
    assert all("jane.roe" not in (r.text or "") and r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert len({r.text for r in got if r.doc_id == 1}) == 1
    assert {r.doc_id: r.text for r in got if r.doc_id in (2, 3)} == {2: None, 3: ""}
    assert corpus_pipeline.pii_stage(spark, df.where("false"), "").count() == 0


def test_every_row_gets_its_pieces(spark):
    rows = [(1, "two words", 1), (1, "two words", 1), (None, "é😀 x", 2), (2, None, 3), (3, "", 4), (4, "y" * 3000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = corpus_pipeline.sentencepiece_stage(spark, df, "").collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    assert {r.doc_id: r.n_pieces for r in got if r.doc_id in (2, 3)} == {2: 0, 3: 0}
    assert corpus_pipeline.sentencepiece_stage(spark, df.where("false"), "").count() == 0

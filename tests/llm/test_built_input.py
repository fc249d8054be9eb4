"""Texts and tables built to hurt: words with equal sums of powers, an entity in very many rows."""

import time
import zlib

import numpy as np
from tokenizers import Tokenizer

from weftgraph.llm import jaccard_join, pii, sentencepiece, token_store
from weftgraph.llm._text import piece_hashes, prefix_sums, word_hashes
from weftgraph.llm.queries import PIECES, WORD_BPE

#: The Thue-Morse word of 1,024 letters and its complement.
ONE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
TWO = ONE.translate(str.maketrans("ab", "ba"))


def test_pair_shares_its_sums():
    buf = np.frombuffer((ONE + TWO).encode(), np.uint8)
    starts, ends = np.array([0, 1024]), np.array([1024, 2048])
    assert len(set(piece_hashes(prefix_sums(buf), starts, ends).tolist())) == 1 and len(set(word_hashes(buf, starts, ends).tolist())) == 2


def test_words_stay_apart(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"{ONE} of four words"), (2, f"{TWO} of four words"), (3, f"{ONE} of four words")], "doc_id bigint, text string").coalesce(1)
    out = sentencepiece.encode(docs, sentencepiece.load_pieces(PIECES), decode_to="decoded").collect()
    assert {r.doc_id: r.decoded for r in out} == {r.doc_id: r.text for r in docs.collect()}
    token_store.write_tokens(docs, f"file://{tmp_path}/tokens", WORD_BPE, end_id=2)
    library = Tokenizer.from_file(WORD_BPE)
    want = {r.doc_id: zlib.crc32(np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], np.uint32).tobytes()) for r in docs.collect()}
    assert {r.doc_id: r.ids_crc32 for r in token_store.read_tokens(spark, f"file://{tmp_path}/tokens", with_ids=False).collect()} == want
    linked = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, words=4, percent=85).collect()}
    assert linked == {1: 1, 2: 2, 3: 1}


def test_entity_of_many_rows(spark):
    """The rows of an entity and the terms that tell of it never meet as a product: time follows the rows."""
    rows = [(i, f"please w{'abcdefghij'[i % 10]}{''.join('klmnopqrst'[int(c)] for c in str(i))} to joint@example.org now" if i % 2 else f"plain words number {i}") for i in range(20_000)]
    began = time.time()
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).selectExpr("doc_id", "size(filter(spans, s -> s.kind = 'email')) as n", "size(spans) as m").collect()
    assert sum(r.n for r in found) == 10_000 and len(found) == 20_000 and time.time() - began < 120
    # Each row's own word tells of the address and is marked in its row alone.
    assert all(r.m >= r.n for r in found)

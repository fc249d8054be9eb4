"""Operators against brute force on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import decontaminate, jaccard_join, language_id, nearest, pii, quality, sentencepiece, suffix_dedup, token_store, url_filter
from weftgraph.llm.queries import PIECES, WORD_BPE

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation"
TEXTS = [None, "", " ", "a", LONG, LONG, LONG + " ullamco", "Zwei " + LONG + " drei", "é😀\n\tà b", "don't <|endoftext|> X9Y8 'll", "x" * 5000, LONG.upper(), "ab " * 300, "▁ ▁x", "Ünï " * 90]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(4, LONG, None), (None, LONG, "n")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, word string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, word string")


def without_repeats(texts):
    """(n_removed, n_spans, kept_sha256) of each text, by a set of all strings of 100 bytes seen so far."""
    seen, out = set(), []
    for b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


def test_suffix_dedup(docs, empty):
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.remove_repeats(docs).collect()}
    texts = [(t or "").encode() for t in TEXTS]
    for i, want in enumerate(without_repeats(texts)):
        r = got[i, len(texts[i])]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == want, i
    assert got[None, len(LONG)].n_removed == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_merges_shards(spark, monkeypatch):
    """Every repeated anchor is hot, so all repeats go through the runs and their merge; passages stand in different surroundings."""
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", 12)
    monkeypatch.setattr(suffix_dedup, "RANGE_STRINGS", 300)
    rng = np.random.default_rng(11)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passages = [noise(int(n)) for n in rng.integers(90, 260, 4)] + [noise(60) + "\0\0" + noise(70) + "\0" * 130, "ab" * 90]
    texts = []
    for _ in range(150):
        parts = [noise(int(rng.integers(0, 40)))]
        for i in rng.integers(0, len(passages), int(rng.integers(1, 4))):
            cut = int(rng.integers(0, 30))
            parts += [passages[i][cut:], noise(int(rng.integers(0, 40)))]
        texts.append("".join(parts))
    ids = rng.permutation(150).tolist()
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)) + [(ids[0], texts[0])], "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    by_id = [t.encode() for _, t in sorted(zip(ids, texts, strict=True))]
    want = without_repeats(by_id)
    assert [got[i] for i in range(150)] == want and sum(w[0] for w in want) > 20_000


def test_merge_of_runs():
    rng = np.random.default_rng(2)
    strings = sorted({bytes(x) for x in rng.integers(0, 3, (60, 4)).astype(np.uint8)})
    for _ in range(50):
        a, b = (sorted(rng.choice(len(strings), int(rng.integers(1, 30)), replace=False).tolist()) for _ in "ab")
        place = {(w, i): (int(rng.integers(0, 5)) * 2 + w, int(rng.integers(0, 9))) for w in (0, 1) for i in range(len(strings))}
        run = lambda w, r: (np.array([strings[i] for i in r], "S4"), np.array([place[w, i][0] for i in r], np.int64), np.array([place[w, i][1] for i in r], np.int32))
        (keys, ids, starts), later = suffix_dedup.merge_runs(run(0, a), run(1, b))
        every = sorted({*a, *b})
        first = [min(place[w, i] for w, r in ((0, a), (1, b)) if i in r) for i in every]
        assert keys.tolist() == np.array([strings[i] for i in every], "S4").tolist() and list(zip(ids, starts, strict=True)) == first
        assert sorted(zip(*(x.tolist() for x in later), strict=True)) == sorted(max(place[0, i], place[1, i]) for i in {*a} & {*b})


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    pieces = [rng.integers(97, 99, n).astype(np.uint8) for n in (150, 40, 90)]
    pieces.append(np.concatenate([pieces[0][20:120], pieces[1]]))
    # A separator of its own behind each piece, as in the operator.
    data = np.concatenate([np.concatenate([p, np.frombuffer(i.to_bytes(8, "big"), np.uint8)]) for i, p in enumerate(pieces)])
    sizes = np.array([len(p) for p in pieces])
    begins = np.cumsum(sizes + 8) - sizes - 8
    order = suffix_dedup.suffix_array(data, 160)
    text = data.tobytes()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    end = {int(b) + j: int(b + n) for b, n in zip(begins, sizes, strict=True) for j in range(n)}
    got = suffix_dedup.common_prefixes(data, order, begins, begins + sizes, 100)
    for place, (x, y) in enumerate(zip(order.tolist(), order[1:].tolist(), strict=False), 1):
        want = 0
        while want < 100 and x + want < end.get(x, 0) and y + want < end.get(y, 0) and text[x + want] == text[y + want]:
            want += 1
        assert y not in end or got[place] == want


def test_jaccard(docs, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()]
    assert len(got) == len(TEXTS) + 2
    by = {g[0]: g for g in got}
    assert by[5][2] == by[6][2] == by[7][2] == by[11][2] == 4 and by[0] == (0, 0, 0) and by[3] == (3, 1, 3) and by[None][2] is None
    assert jaccard_join.jaccard_components(empty).count() == 0


class _All:
    """A bitmap in which all tokens are frequent."""

    value = np.full(1 << 20, (1 << 64) - 1, np.uint64)


@pytest.mark.parametrize(("long", "k"), [(400, 2), (400, 3), (30, 2)])
def test_jaccard_against_all_pairs(spark, long, k):
    """Shared passages make most tokens frequent, so combinations and, in long sets, single frequent tokens decide."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    passages = [[word() for _ in range(int(n))] for n in rng.integers(6, 40, 14)]
    texts = []
    for _ in range(160):
        t = [w for i in rng.choice(14, int(rng.integers(1, 6)), replace=False) for w in passages[i]]
        t = [word() if rng.random() < 0.02 else w for w in t]
        texts.append(" ".join(t))
    texts += [t + " and so on" for t in texts[:40]] + texts[:5]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, key string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, frequent_from=2, minhashes=1, long=long, k=k).collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    least = list(range(len(texts)))
    while True:
        before = list(least)
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= 85 * len(x | y):
                    least[a] = min(least[a], least[b])
        if before == least:
            break
    assert got == {i: (len(s), least[i]) for i, s in enumerate(sets)} and len(set(least)) > 20


def test_jaccard_pairs_share_a_key_that_tells_enough():
    """Of all linked pairs of random sets, all tokens frequent, each shares a key whose places leave room for what the sets share."""
    rng = np.random.default_rng(11)
    for k in (2, 3):
        run, seen = jaccard_join._prefixes(1, 80, k, _All, 400), 0
        for _ in range(150):
            n = int(rng.integers(1, 120))
            one = rng.choice(400, n, replace=False)
            other = np.concatenate([rng.permutation(one)[: n - int(rng.integers(0, 1 + n // 8))], 400 + rng.choice(400, int(rng.integers(0, 1 + n // 8)), replace=False)])
            small, large = sorted((one, other), key=len)
            same = len(np.intersect1d(small, large))
            if 100 * same < 80 * (len(small) + len(large) - same):
                continue
            seen += 1
            (out,) = run(iter([pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([" ".join(f"w{i}" for i in x) for x in (small, large)])], ["id", "text"])]))
            (ka, ma), (kb, mb) = ((np.frombuffer(out.column("keys")[i].as_py(), np.int64), np.frombuffer(out.column("marks")[i].as_py(), np.int32)) for i in (0, 1))
            need = 80 * (len(small) + len(large))
            left = {key for key, mark in zip(ka.tolist(), ma.tolist(), strict=True) if mark % 2 and 180 * (len(small) - mark // 2) >= need}
            assert left & {key for key, mark in zip(kb.tolist(), mb.tolist(), strict=True) if 180 * (len(large) - mark // 2) >= need}
        assert seen > 50


def test_jaccard_keys_of_a_long_text_are_few(spark):
    """20,000 words, all frequent: no combinations; as many keys as the prefix has tokens."""
    text = " ".join(f"w{i}" for i in range(20_000))
    run = jaccard_join._prefixes(4, 85, 2, _All, 400)
    (out,) = run(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])]))
    assert len(out.column("keys")[0].as_py()) // 8 == 3000


def test_tokens_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path, file = f"file://{tmp_path}/t", WORD_BPE
    token_store.write_tokens(docs, path, file)
    library, start = Tokenizer.from_file(file), 0
    rows = sorted(token_store.read_tokens(spark, path).collect(), key=lambda r: r.start)
    texts = sorted([(-1, LONG), *enumerate(TEXTS), (4, LONG)], key=lambda x: x[0])
    for r, (_, t) in zip(rows, texts, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.ids, r.start, r.ids_crc32) == (ids, start, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_block_stretches_decode_alone():
    ids = np.random.default_rng(3).zipf(1.5, 600_000) % 40_000
    share = token_store.frequencies(np.bincount(ids))
    first = np.cumsum(share) - share
    block = token_store.encode_block(ids, share, first)
    table = token_store.unpack_table(token_store.pack_table(share))
    assert (token_store.decode_block(block, *table) == ids).all()
    stretch = token_store.CHECKPOINT_STEPS * token_store.LANES
    assert (token_store.decode_block(block, *table, stretch=1) == ids[stretch : 2 * stretch]).all()
    with pytest.raises(ValueError):
        token_store.decode_block(block[:12] + b"\0\0\0\0" + block[16:], *table)


def viterbi(word, pieces):
    best = [(0.0, [])] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            piece = word[s:e]
            if piece in pieces:
                step = (best[s][0] + pieces[piece][1], [*best[s][1], pieces[piece][0]])
            elif e - s == 1:
                step = (best[s][0] - 1000, [*best[s][1], *(3 + b for b in piece.encode())])
            else:
                continue
            if best[e] is None or step[0] > best[e][0]:
                best[e] = step
    return best[-1][1]


@pytest.mark.parametrize("max_words", [1000, 4])
def test_sentencepiece(docs, max_words):
    pieces = sentencepiece.load_pieces(PIECES)
    table = {r.piece.replace("▁", " "): (r.id, r.score) for r in pieces.itertuples() if r.byte < 0}
    rows = sentencepiece.decode(sentencepiece.encode(docs, pieces, max_words=max_words), pieces).collect()
    both = sentencepiece.encode(docs, pieces, max_words=max_words, decode_to="again").collect()
    assert len(rows) == len(TEXTS) + 2 == len(both) and all(r.again == (r.text or "") for r in both)
    for r in rows:
        assert r.decoded == (r.text or "") and r.word in ("clash", "n", None)
        if r.text:
            words = re.findall(r"[\x00-\x1f]| *[^ \x00-\x1f]+| +", " " + r.text)
            assert r.ids == [i for w in words for i in viterbi(w, table)], r.text


def test_language(docs, empty):
    model = language_id.profiles(docs.selectExpr("if(doc_id = 14, 'de', 'la') as lang", "text"))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 4, 14)] == ["und", "und", "und", "la", "de"] and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(docs, language_id.profiles(empty.selectExpr("word as lang", "text"))).where("lang_pred <> 'und'").count() == 0


def test_language_by_brute_force(spark):
    rng = np.random.default_rng(9)
    word = lambda letters: "".join(rng.choice(list(letters), int(rng.integers(1, 7))))
    kinds = {"aa": "abcdeé", "bb": "bcdefÄ", "cc": "cdefgß"}
    rows = [(i, lang, " ".join(word(kinds[lang]) for _ in range(30)) + "!", 1) for i, lang in enumerate([*kinds] * 12)]
    df = spark.createDataFrame(rows, "doc_id int, lang string, text string, n int")

    def ranked(text):
        counts = Counter()
        for w in re.findall(r"[^\W\d_]+", text):
            padded = [1, *(ord(c.lower()) + 2 for c in w), 1]
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    g = padded[i : i + n]
                    if any(x != 1 for x in g) and (n < 3 or g[1] != 1) and g != [1]:
                        counts[sum(x << 21 * (n - 1 - j) for j, x in enumerate(g))] += 1
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]

    model = language_id.profiles(df.where("doc_id % 2 = 0"), size=60)
    assert "WindowGroupLimit" in model._jdf.queryExecution().executedPlan().toString()
    first = {lang: ranked(" ".join(t for i, k, t, _ in rows if k == lang and i % 2 == 0))[:60] for lang in kinds}
    assert {(r.lang, r.gram): r["rank"] for r in model.collect()} == {(k, g): i for k, gs in first.items() for i, g in enumerate(gs)}
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.identify(df, model, size=60).collect()}
    for i, _, text, _ in rows:
        mine = ranked(text)[:60]
        far = {k: sum(abs(gs.index(g) - j) if g in gs else 60 for j, g in enumerate(mine)) for k, gs in first.items()}
        best = min(sorted(far), key=far.get)
        assert got[i] == (best, round(1 - far[best] / (60 * len(mine)), 9))


def test_pii(spark):
    texts = ["a@b.cd_e@f.g x@y y@z.w..q@r.s", "1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111-1111 1111 x 1234567812345678", "+1 (555) 555-0000x +1 2", None, "", "😀 é@ a@b.c \x01"]
    got = [r.s for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").selectExpr(pii.listed("spans") + " as s").collect()]
    assert got == ["email:0:6,email:6:12,email:17:22,email:22:29", "ip:0:7,ip:8:15", "card:0:19", "phone:0:17", "", "", "email:5:10"]


def test_pii_terms_and_sanitised_text(spark):
    rows = [(i, f"contact Zorblatt{'xy'[i % 2]} zaphod now me@x.org please number {i} zaphod and {'word ' * 20} zaphod") for i in range(4)] + [(i, f"please contact us now on day {i}") for i in range(4, 60)]
    rows += [(60, 'key "04dbebab91ab85687d33eeaaf9ac699e1188f962" 12345678901234567890123 abcdefghijklmnopqrstuvwxyz')]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert "zaphod" not in clean[0] and "me@x.org" not in clean[0] and "please" in clean[0] and clean[30] == rows[30][1]
    assert clean[60] == 'key "<SECRET>" 12345678901234567890123  ' or clean[60].startswith('key "<SECRET>" 12345678901234567890123')


def test_pii_terms_by_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [a + b for a in ("Ab", "cod", "deda", "Fe", "gunu", "lo", "Mira") for b in ("rano", "si", "t", "umbo", "ve'l", "x-y")]
    values = ["a@b.cd", "x.y@z.org", "10.0.0.1", "192.168.7.9", "+49 30 1234567"]
    texts = [None, "", "a@b.cd", "a@b.cd"]
    for _ in range(90):
        part = [str(w) for w in rng.choice(words, 30, p=np.arange(1, len(words) + 1) ** 2 / sum(np.arange(1, len(words) + 1) ** 2))]
        if rng.random() < 0.6:
            part.insert(int(rng.integers(30)), str(rng.choice(values)))
        texts.append(" ".join(part))
    texts += texts[4:8]  # repeated rows count each time
    docs = [(int(i), t, "clash", 1) for i, t in enumerate(texts)] + [(9, texts[9], "again", 2)]
    df = spark.createDataFrame(docs, "doc_id int, text string, term string, key int").repartition(3)
    got = [(r.doc_id, r.s) for r in pii.find_pii(df).selectExpr("doc_id", pii.listed("spans") + " as s").collect()]
    term = re.compile(r"(?<![\w-])(?:[^\W\d_][^\W\d_'-]?(?:[^\W\d_]|['-]){2,}|[A-Z][a-z]{1,2})(?![\w-])")
    kinds = (("email", r"[\w.]+@[\w.]+"), ("ip", r"\d+\.\d+\.\d+\.\d+"), ("phone", r"\+[\d ]+\d"))
    spans = [[(k, m.start(), m.end(), m.group()) for k, p in kinds for m in re.finditer(p, t or "")] for _, t, _, _ in docs]
    found = [[(m.group().lower(), m.start(), m.end(), m.group()) for m in term.finditer(t or "")] for _, t, _, _ in docs]
    near = [{(s[3], w[0]) for s in ss for w in ws if w[2] > s[1] - 60 and w[1] < s[2] + 60 and (w[2] <= s[1] or w[1] >= s[2])} for ss, ws in zip(spans, found, strict=True)]
    count = lambda test: sum(map(test, range(len(docs))))
    told = {}
    for e, w in set().union(*near):
        n_e, n_t = count(lambda i, e=e: any(s[3] == e for s in spans[i])), count(lambda i, w=w: any(x[0] == w for x in found[i]))
        told[e, w] = np.log2(len(docs) * count(lambda i, p=(e, w): p in near[i]) / (n_e * n_t)) / np.log2(len(docs) / n_e)
    want, kinds_seen = [], set()
    for i, (doc, _, _, _) in enumerate(docs):
        marks = []
        for w, a, b, raw in found[i]:
            most = max([told.get((s[3], w), 0) for s in spans[i]], default=0)
            if most >= 0.85 and all(b <= s[1] or a >= s[2] for s in spans[i]):
                marks.append(("drop" if most >= 0.97 else "name" if raw != w else "term", a, b))
        marks.sort(key=lambda m: (("name", "term", "drop").index(m[0]), m[1]))
        kinds_seen |= {m[0] for m in marks}
        want.append((doc, ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in [*spans[i], *marks])))
    assert sorted(got) == sorted(want) and kinds_seen
    assert pii.find_pii(df.where("false")).count() == 0 and pii.sanitise(df).columns == df.columns


def test_nearest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(300)] + [(300, [0.0] * 8), (301, None), (302, [1.0, None] * 4), (303, [float("nan")] * 8)]
    rows += [(400 + i, rows[5][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = nearest.nearest(df, df.where("vec_id % 20 = 0"), block=64).collect()
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    for q in [i for i in good if i % 20 == 0]:
        want = sorted((-sum_of(good[q], v), i) for i, v in good.items() if i != q)[:20]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert not {300, 301, 302, 303} & {r.vec_id for r in got}


def sum_of(x, y):
    total = 0.0
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        total += a * b
    return total


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/x?y", None), (2, "https://a.example.com/en/", None), (3, "x.net/es/", None), (4, None, None), (5, "https://spam.net/es/1", "<a href='//farm.org/'>"), (6, "https://farm.org/q", '<a href="http://spam.net/">'), (7, "https://good.org", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string"), threshold=0.4).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block") and got[3] == ("", "", None, "allow") == got[4]
    assert got[5][3] == "block" and got[6][2:] == (None, "block") and got[7] == ("good.org", "", None, "allow")


def test_urls_link_farms_are_blocked(spark):
    spam = "<a href='//spam.net/'> <a href='http://junk.net/x'>"
    rows = [(1, "https://spam.net/es/1", "<a href='//good.org'>"), (2, "https://junk.net/fr/", None), (3, "https://good.org/", "<a href='//fine.org'>")]
    rows += [(100 + i, f"https://www.farm{i}.org/", spam) for i in range(30)]
    rows += [(200 + i, f"https://fine{i}.org/", "<a href='//spam.net/'> <a href='//good.org/'> <a href='//fine.org/'>") for i in range(30)]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert [i for i, v in got.items() if v == "block" and i > 2] == [i for i in got if 100 <= i < 200] and got[1] == got[2] == "block"


def test_urls_by_brute_force(spark):
    """Trust and distrust at the default parameters, by plain iteration to the limit."""
    rng = np.random.default_rng(12)
    hosts = [f"h{i}.org" for i in range(20)] + ["www.h3.org", "spam.net", "junk.net", "ok.com", "fine.com"]
    rows = []
    for i in range(160):
        h = hosts[int(rng.integers(len(hosts)))]
        path = "/es/x" if h == "spam.net" or (h == "junk.net" and rng.random() < 0.5) else "/a"
        to = rng.choice(["spam.net"] if h in hosts[:4] else ["spam.net", "junk.net"] if h in hosts[:6] else hosts, int(rng.integers(0, 4)))
        rows.append((i, f"https://{h}{path}", " ".join(f'<a href="https://{t}/">' for t in to)))
    rows += [rows[0], (None, rows[1][1], rows[1][2]), (500, None, None), (501, "", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id int, url string, html string, host string")
    got = Counter((r.page_id, r.verdict) for r in url_filter.judge_urls(df).collect())
    parsed = [(i, u.split("/")[2] if u else "", "/" + u.split("/", 3)[3] if u else "", set(re.findall(r'https://([^/"]+)', h or "")) if u else set()) for i, u, h in rows]
    rule = lambda h, p: "block" if h.endswith("net") and p.startswith(("/es/", "/fr/")) else "allow" if h.endswith(".com") else None
    n, page, vouch = Counter(), Counter(), Counter()
    seed: dict = {}
    for _, h, p, to in parsed:
        if h:
            n[h] += 1
            seed.setdefault(h, Counter())[rule(h, p)] += 1
            for t in to - {h}:
                page[h, t] += 1
    for h in n:
        if h.count(".") > 1:
            parent = h.split(".", 1)[1]
            vouch[h, parent] += 1
            vouch[parent, h] += 1
    links = page + vouch
    total, on_page = Counter(), Counter()
    for (a, _), c in links.items():
        total[a] += c
    for (a, _), c in page.items():
        on_page[a] += c
    every = {x for e in links for x in e} | set(n)
    trust, distrust = dict.fromkeys(every, 0.0), dict.fromkeys(every, 0.0)
    for _ in range(60):
        t2 = {h: 0.5 * seed.get(h, {}).get("allow", 0) / max(1, n[h]) for h in every}
        d2 = {h: 0.5 * seed.get(h, {}).get("block", 0) / max(1, n[h]) for h in every}
        for (a, b), c in links.items():
            t2[b] += 0.5 * trust[a] * c / total[a]
            d2[a] += 0.5 * distrust[b] * (page[a, b] / on_page[a] if on_page[a] else c / total[a])
        trust, distrust = t2, d2
    want = Counter((i, rule(h, p) or ("block" if h and distrust[h] - trust[h] >= 0.25 - 1e-9 else "allow")) for i, h, p, _ in parsed)
    assert got == want
    unruled = {h: "block" if distrust[h] - trust[h] >= 0.25 else "allow" for h in n if h.endswith("org")}
    assert set(unruled.values()) == {"block", "allow"}
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_quality_gradient_and_prior():
    rng = np.random.default_rng(4)
    p, u = rng.normal(0.5, 1, (40, 6)), rng.normal(0, 1, (50, 6))
    signs = set()
    for prior in (0.2, 0.9):
        for _ in range(6):
            w = rng.normal(0, 2, 6)
            one, two = quality.nnpu_risk(w, p, u, prior)
            signs.add(two >= 0)
            aim = lambda w, prior=prior, two=two: sum(quality.nnpu_risk(w, p, u, prior)) if two >= 0 else -quality.nnpu_risk(w, p, u, prior)[1]
            numeric = [(aim(w + d) - aim(w - d)) / 2e-6 for d in np.eye(6) * 1e-6]
            assert np.allclose(numeric, quality.nnpu_gradient(w, p, u, prior), atol=1e-5)
    assert signs == {True, False}
    good, bad = rng.normal(2, 1, (3000, 5)), rng.normal(-2, 1, (3000, 5))
    for share in (0.2, 0.5, 0.8):
        mixed = np.concatenate([good[1000 : 1000 + int(2000 * share)], bad[: int(2000 * (1 - share))]])
        assert abs(quality.class_prior(good[:1000], mixed[rng.permutation(len(mixed))]) - share) < 0.06


def test_quality(spark, docs, empty):
    rows = [(i, ("plain words, " if i % 4 else "BAD$$$ ||| ") * 20, i % 4 > 0) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, y boolean")
    model = quality.train(df, df.selectExpr("doc_id", "cast(y as int) as quality"))
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((got[i] >= 0.3) == y for i, _, y in rows)
    assert len(quality.score(docs, model).collect()) == len(TEXTS) + 2
    assert quality.score(empty, quality.train(empty, empty.selectExpr("doc_id", "1 as quality"))).count() == 0


def test_decontaminate(spark, docs):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), 6))
    items = [[word() for _ in range(40)] for _ in range(5)]
    rows = [(i, " ".join(word() for _ in range(150))) for i in range(60)]
    rows += [(100 + i, " ".join([word() for _ in range(50)] + x + [word() for _ in range(50)])) for i, x in enumerate(items)]
    rows += [(200 + i, " ".join(word() if j % 5 == 0 else w.upper() for j, w in enumerate(x))) for i, x in enumerate(items)]
    df = spark.createDataFrame([*rows, (None, "x"), (7, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (9, None), (None, "a b")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(100 + i, i) for i in range(5)} | {(200 + i, i) for i in range(5)}
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.lcs([1, 2, 3, 4], [2, 9, 4, 3]) == 2


def test_decontaminate_finds_an_item_in_half_of_all_rows(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(n))
    leak, other = text(40), text(40)
    bench = spark.createDataFrame([(0, leak), (1, other)], "item_id bigint, text string")
    for n in (60, 4):
        rows = [(i, text(40) + (f" {leak} " if i % 2 else " ") + text(40)) for i in range(n)]
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
        assert got == {(i, 0) for i in range(1, n, 2)}


def test_decontaminate_finds_whole_copies_at_any_rank_and_length(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijklm"), 5)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [text(n) for n in [4, 8, 20, 33, 50] * 8 + [700]]
    rows = [(i, f"{text(37)} {x.upper()}, {text(41)}") for i, x in enumerate(items)] + [(100 + i, text(120)) for i in range(20)]
    # One word of six is another one, far from the directions that are left.
    rows += [(200 + i, " ".join(w if j % 6 else "other" for j, w in enumerate(x.split()))) for i, x in enumerate(items) if len(x) > 200]
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.lcs for r in decontaminate.contaminated(df, bench, rank=2).collect()}
    assert set(got) == {(i, i) for i in range(41)} | {(200 + i, i) for i, x in enumerate(items) if len(x) > 200}
    assert all(got[i, i] == 1 for i in range(41))


def test_sentencepiece_long_words(spark):
    pieces = sentencepiece.load_pieces(PIECES)
    table = {r.piece.replace("▁", " "): (r.id, r.score) for r in pieces.itertuples() if r.byte < 0}
    rng = np.random.default_rng(4)
    texts = ["x" * 900, "=" * 401, "-" * 300 + " a " + "=-" * 200, "".join(rng.choice(list("abcdeinorst"), 700)), "http://a.de/" + "station/interest" * 40, "的一是不了人我在有他" * 60, "é😀▁z" * 150]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for max_words in (1000, 1):
        for r in sentencepiece.encode(df, pieces, max_words=max_words, decode_to="again").collect():
            words = re.findall(r"[\x00-\x1f]| *[^ \x00-\x1f]+| +", " " + r.text)
            assert r.again == r.text and r.ids == [i for w in words for i in viterbi(w, table)], r.text[:20]


def test_decontaminate_recall_on_paraphrases(spark):
    """40 items between other words: with 10, 20 and 30 % of the words replaced, and with their sentences in another order."""
    rng = np.random.default_rng(7)
    rare = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(4000)]
    common = ["the", "of", "and", "to", "in", "a"]
    word = lambda: str(rng.choice(common) if rng.random() < 0.3 else rng.choice(rare))
    items = [[[word() for _ in range(int(rng.integers(6, 11)))] for _ in range(5)] for _ in range(40)]
    as_text = lambda part: ". ".join(" ".join(s) for s in part)
    ways = {"0": 0.0, "10": 0.1, "20": 0.2, "30": 0.3, "order": 0.0}
    rows, want = [(10_000 + i, " ".join(word() for _ in range(200))) for i in range(200)], {}
    for name, share in ways.items():
        for i, item in enumerate(items):
            part = [[word() if rng.random() < share else w for w in s] for s in item]
            part = [part[j] for j in rng.permutation(5)] if name == "order" else part
            want[len(want)] = (name, i)
            rows.append((len(want) - 1, " ".join(word() for _ in range(60)) + ". " + as_text(part) + ". " + " ".join(word() for _ in range(60))))
    bench = spark.createDataFrame([(i, as_text(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()
    assert all(want.get(r.doc_id, (0, -1))[1] == r.item_id for r in got)
    hits = Counter(want[r.doc_id][0] for r in got)
    assert hits["0"] == hits["10"] == 40 and hits["20"] >= 39 and hits["30"] >= 36 and hits["order"] >= 38

"""Text operators against brute force, libraries, round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.llm import bpe, dac, ftrl, language, licenses, near, quality, secrets
from shardloom.llm.bpe import LONG, BpeCodec
from shardloom.llm.counts import PrefixCounts, count_tokens, prefix_counts
from shardloom.llm.decontaminate import contamination
from shardloom.llm.encode import decode_ids, encode_documents
from shardloom.llm.exact import BLANKS, exact_groups
from shardloom.llm.language import fit_language, languages, train_language
from shardloom.llm.near import near_classes
from shardloom.llm.quality import fit_quality, quality_scores, train_quality
from shardloom.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\t \x0b\x0c\r",
    "a",
    "the of the of the of",
    "don't we'll  x<|endoftext|>y <|endoftext|>",
    "½ ² Ⅷ é è ñ 漢字 😀     \x1c \x85",
    "a" * 3000,
    "ab " * 2000 + " " * 500,
    "=-" * 300,
    "\U00010ed9 ՘x",
    "x́y﻿​",
]


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sample(spark, sf, n=60):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(n).collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


# -- 1 and 3: BPE ----------------------------------------------------------------------------------


def test_encode_and_decode_equal_the_library(spark, sf, library):
    texts = ODD_TEXTS + sample(spark, sf)
    got = {r.doc_id: r for r in encode_documents(docs(spark, texts), vocabulary(), keep_text=True).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want, t
        assert got[i].decoded == library.decode(want, skip_special_tokens=False) == (t or "")
        assert got[i].n_tokens == len(want)
    narrow = {r.doc_id: r for r in encode_documents(docs(spark, texts), vocabulary()).collect()}
    for i in got:
        assert narrow[i].ids == hashlib.sha256(",".join(map(str, got[i].ids)).encode()).hexdigest()
        assert narrow[i].decoded == hashlib.sha256(got[i].decoded.encode()).hexdigest()


def test_random_strings_equal_the_library(library):
    c, rnd = BpeCodec(vocabulary()), random.Random(5)
    pieces = [b.decode("utf-8", "ignore") for b in c.t.bytes_of]
    texts = ["".join(rnd.choice("ab the\n\t 's<|>1²é字😀") for _ in range(rnd.randrange(50))) for _ in range(1500)]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 9))) for _ in range(1500)]
    for t, raw, e in zip(texts, c.encode_raw(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == e.ids, t


def test_any_ids_decode_as_in_the_library(spark, library):
    rnd = random.Random(6)
    rows = [(i, [rnd.randrange(50257) for _ in range(rnd.randrange(8))]) for i in range(200)] + [(200, None)]
    got = {r.doc_id: r.decoded for r in decode_ids(spark.createDataFrame(rows, "doc_id long, ids array<int>"), vocabulary()).collect()}
    assert all(got[i] == library.decode(ids or [], skip_special_tokens=False) for i, ids in rows)


def test_short_and_long_paths_agree():
    c, rnd = BpeCodec(vocabulary()), random.Random(7)
    words = sorted(({"".join(rnd.choice("thein aé") for _ in range(rnd.randrange(1, LONG))).encode()[:LONG] for _ in range(300)}), key=len, reverse=True)
    last, count = c._many(words)
    for i, w in enumerate(words):
        a, b = c._long(w)
        assert last[1 : len(w) + 1, i].tolist() == a[1:] and count[: len(w) + 1, i].tolist() == b


def test_automaton_is_small_and_names_the_longest_token_that_ends_a_prefix():
    t = BpeCodec(vocabulary()).t
    assert sum(v.nbytes for v in vars(t).values() if isinstance(v, np.ndarray)) < 24 << 20  # each worker of an executor has it
    specials = set(t.special.values())
    known = {b: i for i, b in enumerate(t.bytes_of) if b and i not in specials}
    rng = random.Random(3)
    for text in [x for x in ODD_TEXTS if x] + ["".join(rng.choices("etaoin shrdlu\té漢", k=300))]:
        raw, states = text.encode(), np.zeros(1, np.int64)
        for j, byte in enumerate(raw[:400], 1):
            states = t.step(states, np.array([byte], np.uint8))
            longest = next(known[raw[i:j]] for i in range(max(0, j - 130), j) if raw[i:j] in known)
            assert t.longest[states[0]] == longest


def test_prefix_counts_answer_budgets_without_encoding_again(spark, sf, library):
    c = BpeCodec(vocabulary())
    for t in [x for x in ODD_TEXTS + sample(spark, sf, 5) if x and len(x) < 4000]:
        p = prefix_counts(c, t)
        assert isinstance(p, PrefixCounts) and p.total == len(library.encode(t, add_special_tokens=False).ids)
        raw = t.encode()
        for budget in (0, 1, 5, p.total, p.total + 3):
            cut = p.cut(budget)
            head = raw[:cut].decode()
            assert p.at(cut) <= budget and (budget < p.total or cut == len(raw))
            assert all(p.at(j) > budget for j in range(cut + 1, min(len(raw), cut + 300)) if j in p.ends or raw[j] & 0xC0 != 0x80 and j < p.ends[np.searchsorted(p.ends, cut, side="right")])
            assert len(library.encode(head, add_special_tokens=False).ids) <= budget or head != t
    word = b"internationalisation"
    assert c.prefix_counts(word).tolist() == [len(c.encode(word[:j].decode())) for j in range(len(word) + 1)]


def test_counts(spark, library):
    got = {r.doc_id: r for r in count_tokens(docs(spark, ODD_TEXTS), vocabulary(), (3,)).collect()}
    for i, t in enumerate(ODD_TEXTS):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
        assert got[i].cut_3 <= got[i].n_bytes


def test_prefix_counts_are_stored_in_one_array_whatever_the_blocks(library, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(2000)) for _ in range(10)]
    texts += [x for x in ODD_TEXTS if x and "\U00010ed9" not in x] + [None, "漢字 が  <|endoftext|> é " * 40, "<|endoftext|>" * 3]
    expected = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    c = BpeCodec(vocabulary())
    c.count(["warm up"])
    tracemalloc.start()
    assert c.count(texts) == expected
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20_000 * 190  # an array of its own for each pretoken takes more
    monkeypatch.setattr(bpe, "CACHE", 500)
    assert [n for t in texts for n in c.count([t])] == expected and c.count(texts) == expected
    pieces = c.pretokens(texts[0])[:50]
    c.count(texts)
    assert [p.tolist() for p in c.prefix_counts_of(pieces)] == [c.prefix_counts(p.encode()).tolist() for p in pieces]


def test_counts_of_one_long_pretoken_and_odd_tables(spark, library):
    c = BpeCodec(vocabulary())
    p = prefix_counts(c, "a" * 3000)
    assert p.total == len(library.encode("a" * 3000, add_special_tokens=False).ids) and 0 < p.cut(5) < 3000 and p.at(p.cut(5)) <= 5
    assert count_tokens(docs(spark, []), vocabulary()).count() == 0
    rows = spark.createDataFrame([(1, "a b", 7), (1, "a b", 8), (None, None, 9)], "doc_id long, text string, n_tokens long")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(rows, vocabulary()).collect()) == [(0, 0), (1, 2), (1, 2)]


# -- 6: directly addressable codes -----------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4000])
def test_codes_round_trip_and_give_any_token(n):
    rnd = np.random.default_rng(n)
    ids = np.where(rnd.random(n) < 0.5, rnd.integers(0, 256, n), rnd.integers(0, 1 << 22, n)).astype(np.uint32)
    b = dac.Block(dac.pack(ids, np.array([5, 9]), np.array([n // 3, n])))
    assert (b.slice(0, n) == ids).all() and (b.document(1) == ids[n // 3 :]).all() and b.keys.tolist() == [5, 9]
    assert all(b.token(i) == ids[i] for i in range(n))
    for _ in range(40):
        x, y = sorted(rnd.integers(0, n + 1, 2).tolist())
        assert (b.slice(x, y) == ids[x:y]).all()


def test_files_hold_the_library_ids_in_order(spark, sf, library, tmp_path):
    texts = ODD_TEXTS + sample(spark, sf)
    table = docs(spark, texts).repartition(3)
    dac.write_codes(table, str(tmp_path / "codes"), vocabulary(), block_ids=500)
    got = dac.read_codes(spark, str(tmp_path / "codes"), with_ids=True).orderBy("doc_id").collect()
    assert spark.read.parquet(str(tmp_path / "codes")).count() > 3
    at = 0
    for r, t in zip(got, texts, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.ids, r.start, r.n_tokens) == (ids, at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


@pytest.mark.parametrize("odd", [" ", "\n", " \n\t ", "\u00a0 ", "ab", "é", "7", "!?"])
def test_files_of_long_runs_hold_the_library_ids(library, odd):
    text = "x" + (odd * 1_100_000)[: 1_100_000 if odd.isspace() else 60_000] + "y"
    assert dac.has_long_run(text)
    assert dac.fast_encoder(vocabulary())([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_files_of_an_empty_table_and_null_keys(spark, tmp_path):
    empty = docs(spark, [])
    dac.write_codes(empty, str(tmp_path / "e"), vocabulary())
    assert dac.read_codes(spark, str(tmp_path / "e")).count() == 0
    some = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b")], "doc_id long, text string")
    dac.write_codes(some, str(tmp_path / "n"), vocabulary())
    assert [(r.doc_id, r.start) for r in dac.read_codes(spark, str(tmp_path / "n")).orderBy("start").collect()] == [(None, 0), (3, 2), (3, 4)]


# -- 4 and 5: classifiers --------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = train_quality(d, labels)
    rows = quality_scores(d, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert len(bad) > 3 and np.mean([[a > b for a in good] for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.95 and np.mean([s < 0.3 for s in bad]) > 0.9


def test_quality_does_not_learn_from_held_out_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    d = spark.createDataFrame([(i, "good text here") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, 0) for i in ids], "doc_id long, quality int, toxic int")
    assert set(quality.QualityModel.score(train_quality(d, labels), pa.array(["good text here", "", None])).tolist()) == {0.5}


def test_quality_starts_no_workers_for_rows_of_the_driver(spark, monkeypatch):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    expected = train_quality(d, labels)

    def refuse(*_, **__):
        raise AssertionError("rows pickled by the driver take workers of their own on executors")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    for column in (F.col("doc_id"), F.concat(F.lit("k"), F.col("doc_id").cast("string"))):
        model = train_quality(d.withColumn("doc_id", column), labels.withColumn("doc_id", column))
        assert model.weights.any()
    assert np.array_equal(train_quality(d, labels).weights, expected.weights)


@pytest.mark.parametrize("before", [None, ("0", "64m"), ("5", "1024")])
def test_batches_are_bounded_whatever_the_session_has(spark, before):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    for i, k in enumerate(names):
        spark.conf.set(k, before[i]) if before else spark.conf.unset(k)
    count_tokens(docs(spark, ["a"]), vocabulary())
    now = [spark.conf.get(k) for k in names]
    assert now == (list(before) if before == ("5", "1024") else ["2000", str(8 << 20)])
    quality_scores(docs(spark, ["a"]), fit_quality([("a", 1)]))
    assert int(spark.conf.get(names[1])) <= 2 << 20
    for k in names:
        spark.conf.unset(k)


def test_quality_of_odd_texts_and_blocks(spark):
    m = fit_quality([("clean words in a row", 1), ("NOISE!! NOISE!! NOISE!!", 0)] * 20)
    got = quality_scores(docs(spark, ODD_TEXTS), m, keep=("lang", "n_chars")).orderBy("doc_id").collect()
    assert len(got) == len(ODD_TEXTS) and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    one = m.score(pa.array([t or "" for t in ODD_TEXTS]))
    assert np.allclose(one, [m.score(pa.array([t or ""]))[0] for t in ODD_TEXTS])
    assert quality_scores(docs(spark, []), m).count() == 0


def test_fitting_quality_needs_little_memory_beside_the_texts():
    rnd = random.Random(20)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    rows = [(" ".join(word() for _ in range(600)), i % 2) for i in range(600)]
    fit_quality(rows[:2])
    tracemalloc.start()
    try:
        fit_quality(rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 22_000_000  # for 2 MB of text; 36 MB when examples were held in 64-bit numbers, from larger blocks


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = languages(d, train_language(d)).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_document_frequencies_against_brute_force(spark):
    texts = ["the house", None, "", "123", "the the tree", "the house", "x" * 50_000 + " the"]
    n, df = language.document_frequencies(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3))
    want = np.zeros(1 << language.BITS, int)
    for t in texts:
        n_letters, at, _ = next(language.counts([t]))
        if n_letters:
            want[at] += 1
    assert n == 4 and df.tolist() == want.tolist() and want.max() == 4
    n, df = language.document_frequencies(docs(spark, []))
    assert n == 0 and not df.any()


def test_sparse_counts_of_short_and_long_texts_agree(monkeypatch):
    texts = ["The tree, the tree and a house", "", None, "äöü ß 1 x"]
    short = [(n, at.tolist(), c.tolist()) for n, at, c in language.counts(texts)]
    monkeypatch.setattr(language, "MANY", 1)
    assert [(n, at.tolist(), c.tolist()) for n, at, c in language.counts(texts)] == short


def test_rare_languages_are_learned(spark):
    rows = [(i, "the and of house in a garden", "en", "x") for i in range(3_000)] + [(10_000 + i, "der und das haus im garten", "de", "x") for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    assert train_language(d, sample=20, least=0).names == ["en"]
    m = train_language(d, sample=20, least=8)
    assert m.names == ["de", "en"] and m.predict(["das haus und der garten"])[0] == ["de"]
    got = languages(d.unionByName(d), m)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == 2 * len(rows)
    assert languages(d.limit(0), m).count() == 0 and train_language(d.limit(0)).names == []


def test_samples_are_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, "word " * (400 if i % 2 else 4000), int(i % 2)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    monkeypatch.setattr(ftrl, "SAMPLE_BYTES", 100_000)
    monkeypatch.setattr(ftrl, "LONGEST", 10_000)
    got = ftrl.bounded_sample(d, "doc_id", 1_000, "text")
    assert 20 < len(got) < 100 and all(len(r["text"]) == 2000 for r in got)
    seen = []
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 100_000)
    monkeypatch.setattr(quality, "fit_quality", lambda rows: seen.extend(rows) or fit_quality(rows))
    train_quality(d, d.select("doc_id", "quality"))
    assert 0 < sum(len(t) for t, _ in seen) <= 100_000


def test_language_of_odd_texts(spark):
    m = fit_language([("the and of house", "en"), ("der und das haus", "de")] * 40)
    got = {r.doc_id: r for r in languages(docs(spark, ODD_TEXTS), m).collect()}
    for i, t in enumerate(ODD_TEXTS):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), t
    assert fit_language([]).predict(["abc"]) == (["und"], [0.0])
    assert fit_language([("abc def", "xx")]).predict(["abc"])[0] == ["xx"]
    assert m.predict(["der und", "the of"])[0] == ["de", "en"]


# -- 7: near duplicates ----------------------------------------------------------------------------


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_against_full_edit_distance():
    rnd, pairs = random.Random(8), []
    for _ in range(250):
        a = [rnd.randrange(25) for _ in range(rnd.randrange(70))]
        b = list(a)
        for _ in range(rnd.randrange(1 + len(a) // 3)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(2)] = [rnd.randrange(25) for _ in range(rnd.randrange(2))]
        pairs.append((np.array(a, np.int32), np.array(b, np.int32)))
    for (a, b), s in zip(pairs, near.similar(pairs), strict=True):
        true = 1 - edit(a.tolist(), b.tolist()) / max(len(a), len(b), 1)
        assert (s > 0) == (true >= 0.8 - 1e-9) and s <= true + 1e-9


def test_alignment_drops_only_pairs_beyond_both_bounds():
    rnd, pairs = random.Random(18), []
    for _ in range(120):
        a = [rnd.randrange(25) for _ in range(rnd.randrange(20, 90))]
        b = [x if rnd.random() < rnd.choice([0.3, 0.8, 0.95]) else rnd.randrange(25) for x in a][rnd.randrange(6) :]
        pairs.append((np.array(a, np.int32), np.array(b, np.int32)))
    true = np.array([edit(a.tolist(), b.tolist()) for a, b in pairs])
    for band in (3, 8, 40):
        most = np.array([rnd.randrange(1, 30) for _ in pairs])
        got, bound = near.band_distance(pairs, band, most), np.minimum(band, most)
        assert (got[true <= bound] == true[true <= bound]).all() and (got[true > bound] > bound[true > bound]).all()


@pytest.mark.parametrize("count_links", [True, False])
def test_a_class_that_fits_one_block_is_dealt_once(spark, monkeypatch, count_links):
    """Versions of 30 texts around a shared passage, on both sides of a length class's bound, and many copies of one of them."""
    rows, real = {}, near.through_table

    def counted(df, kind, keep=False):
        out = real(df, kind, keep)
        rows[kind] = out.count()
        return out

    monkeypatch.setattr(near, "through_table", counted)
    rnd = random.Random(19)
    word = lambda: "".join(rnd.choice("klmnopqrst") for _ in range(5))
    passage, texts = [word() for _ in range(85)], []
    for f in range(30):
        own = [word() for _ in range(28 + f)]
        # the longer version comes first for every other text
        pair = [" ".join(own + passage), " ".join([word() if i % 4 == 0 else w for i, w in enumerate(own)] + passage + [word() for _ in range(8)])]
        texts += pair[:: 1 if f % 2 else -1]
    texts += [" ".join([*texts[0].split(), word()]) for _ in range(20)]
    got = near_classes(docs(spark, texts), count_links=count_links).orderBy("doc_id").collect()
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = texts[i].split(), texts[j].split()
            if want[i] != want[j] and edit(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    assert [r.class_id for r in got] == want and 1 < len(set(want)) < len(texts)
    assert 0 < rows["near-dealt"] <= rows["near-roles"]


def test_classes_hold_planted_copies_and_leave_others_alone(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    base = [[word() for _ in range(rnd.randrange(40, 200))] for _ in range(25)]
    texts, family = [], []
    for f, b in enumerate(base):
        for v in range(1 + (f % 4) * 10):
            w = list(b)
            for _ in range(len(w) // 45 if v else 0):
                w[rnd.randrange(len(w))] = word()
            texts.append((" " if v % 3 else "  ").join(w).upper() if v % 5 == 4 else " ".join(w))
            family.append(f)
    rows = near_classes(docs(spark, texts)).orderBy("doc_id").collect()
    first = {}
    for i, f in enumerate(family):
        first.setdefault(f, i)
    assert [r.class_id for r in rows] == [first[f] for f in family]
    assert sum(r.kept for r in rows) == 25 and all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_a_hot_passage_does_not_join_texts(spark):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("klmnopqrst") for _ in range(5))
    passage = [word() for _ in range(55)]
    texts = [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]) for _ in range(80)]
    rows = near_classes(docs(spark, texts)).collect()
    assert all(r.class_id == r.doc_id and r.n_links == 0 for r in rows)


def test_near_classes_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "one two"), (5, "One, two"), (6, "one two three"), (None, "one two"), (7, "x " * 3000), (8, "x " * 3000 + "y"), (4, "one two")]
    got = sorted((r.doc_id or -1, r.class_id) for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, None), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7)]
    assert near_classes(docs(spark, [])).count() == 0


@pytest.mark.parametrize("count_links", [True, False])
def test_large_buckets_leave_no_pair_untried(spark, monkeypatch, count_links):
    """Pairs of versions around a shared passage: the hubs of the large buckets are within 0.8 of few of them."""
    monkeypatch.setattr(near, "BLOCK", 7)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("klmnopqrst") for _ in range(5))
    passage, texts = [word() for _ in range(60)], []
    for _ in range(30):
        own = [word() for _ in range(40)]
        # every third own word differs, so the two share sketches of the passage only
        texts += [" ".join(own + passage), " ".join([word() if i % 3 == 0 else w for i, w in enumerate(own)] + passage)]
    rows = near_classes(docs(spark, texts), count_links=count_links).orderBy("doc_id").collect()
    assert [r.class_id for r in rows] == [i // 2 * 2 for i in range(60)]
    assert {r.n_links for r in rows} == {1 if count_links else None}


def test_texts_at_the_least_similarity_meet(spark):
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("klmnopqrst") for _ in range(6))
    texts = []
    for i in range(80):
        # a long text with every fifth word changed, or a short one with one word changed, put in or left out
        w = [word() for _ in range(150 if i < 40 else 5 + i % 5)]
        v = list(w)
        if i < 40:
            v[2::5] = [word() for _ in v[2::5]]
        else:
            at = rnd.randrange(len(w))
            v[at : at + 1] = [[word()], [w[at], word()], []][rnd.randrange(3 if 5 < len(w) < 9 else 1)]
        texts += [" ".join(w), " ".join(v)]
    rows = near_classes(docs(spark, texts)).orderBy("doc_id").collect()
    met = [rows[i].class_id == rows[i + 1].class_id for i in range(0, len(rows), 2)]
    assert sum(met[:40]) >= 38 and all(met[40:])


def test_common_runs_and_words_against_counters():
    rnd, pairs = random.Random(15), []
    for _ in range(120):
        a = [rnd.randrange(1, 30) for _ in range(rnd.randrange(0, 300))]
        b = list(a)
        for _ in range(rnd.randrange(1 + len(a) // 3)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(2)] = [rnd.randrange(30) for _ in range(rnd.randrange(2))]
        pairs.append((np.array(a, np.int32), np.array(b, np.int32)))
    runs = lambda w, q: collections.Counter(tuple(w[i : i + q].tolist()) for i in range(len(w) - q + 1))
    for q in (1, 3):
        assert near.common_runs(pairs, q).tolist() == [sum((runs(a, q) & runs(b, q)).values()) for a, b in pairs]


def test_bitmaps_bound_the_words_that_are_lacking(spark):
    rnd, rows, want = random.Random(16), [], []
    for i in range(150):
        a = [rnd.randrange(1, 60) for _ in range(rnd.randrange(5, 300))]
        b = [x if rnd.random() > i / 300 else rnd.randrange(1, 60) for x in a] + [1] * rnd.randrange(1 + len(a) // 4)
        x, y = (collections.Counter(t) for t in (a, b))
        want.append(max(sum((x - y).values()), sum((y - x).values())))
        bits, off = near.bitmaps(np.array(a + b, np.uint64), np.array([0, len(a), len(a) + len(b)]))
        rows.append((i, bits[: off[1]].tolist(), bits[off[1] :].tolist()))
    got = spark.createDataFrame(rows, "i long, p array<bigint>, q array<bigint>").select("i", near.lacking("p", "q").alias("n")).orderBy("i").collect()
    assert all(r.n <= w for r, w in zip(got, want, strict=True)) and sum(r.n for r in got) >= 0.6 * sum(want)


@pytest.mark.parametrize("low, high", [(0.80, 0.85), (0.85, 0.90), (0.90, 1.0)])
def test_recall_of_links_by_band_of_similarity(spark, low, high):
    """Substitutions, insertions and deletions at random; the similarity is the full edit distance's."""
    rnd = random.Random(int(low * 100))
    word = lambda: "".join(rnd.choice("klmnopqrst") for _ in range(6))
    texts = []
    while len(texts) < 80:
        w = [word() for _ in range(rnd.choice([15, 50, 100, 200]))]
        v = list(w)
        for _ in range(rnd.randint(1, len(w) // 4)):
            at = rnd.randrange(len(v))
            v[at : at + 1] = [[word()], [v[at], word()], []][rnd.randrange(3)]
        if low <= 1 - edit(w, v) / max(len(w), len(v)) < high:
            texts += [" ".join(w), " ".join(v)]
    rows = near_classes(docs(spark, texts), count_links=False).orderBy("doc_id").collect()
    met = [rows[i].class_id == rows[i + 1].class_id for i in range(0, len(rows), 2)]
    assert sum(met) >= 0.9 * len(met), sum(met)


def brute_classes(texts, least=0.8):
    """Classes by the full edit distance of all pairs of different word sequences."""
    ws = [tuple(re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))) for t in texts]
    first, ids = {}, {}
    for i, w in enumerate(ws):
        first.setdefault(w, i)
        for x in w:
            ids.setdefault(x, len(ids))
    label = {i: i for i in first.values()}
    whole = sorted((w for w in first if len(w) >= 5), key=len)
    for i, a in enumerate(whole):
        for b in whole[i + 1 :]:
            if len(a) < len(b) * least:
                break
            most = int((1 - least) * len(b) + 1e-9)
            if sum((collections.Counter(b) - collections.Counter(a)).values()) <= most and edit(a, b) <= most:
                x, y = label[first[a]], label[first[b]]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return [label[first[w]] for w in ws]


def test_memory_of_a_block_grows_with_its_texts_not_with_their_pairs(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    got, real = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, f, schema: (got.append(f), real(self, f, schema))[1])
    large = spark.range(20).selectExpr("7L key", "id k", "9L n")
    table = spark.range(20).selectExpr("id k", "9L n", "array(1L, 2L) bits", "unhex(repeat('00', 36)) ws", f"array_repeat(7L, {near.SKETCHES}) keys")
    near.block_links(large, table, large.selectExpr("k", "k label"))
    look, compare = got
    r, n, words = np.random.default_rng(1), near.BLOCK, 60
    lists = np.where(r.random((n, words)) < 0.05, r.integers(0, 1 << 30, (n, words)), r.integers(0, 1 << 30, words)).astype("<i4")
    bits, off = near.bitmaps(lists.reshape(-1).astype(np.uint64), np.arange(n + 1) * words)
    rows = {"key": [7] * n, "g": [1] * n, "p": ["all"] * n, "at": pa.array([near.BOTH] * n, pa.int32()), "k": list(range(n)), "label": list(range(n))}
    first = pa.table(rows | {"n": [words] * n, "bits": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(bits))})
    second = pa.table(rows | {"ws": [w.tobytes() for w in lists], "keys": [[7] * near.SKETCHES] * n})
    out = []
    for f, group in ((look, first), (compare, second)):
        tracemalloc.start()
        out.append(f(group))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6, f"{f.__name__}: {peak / 1e6:.0f} MB"
    assert out[0].num_rows == n and out[1].num_rows > 0.9 * n
    # strips of one text each give the same
    monkeypatch.setattr(near, "CELLS", 1)
    small = [g.slice(0, 300) for g in (first, second)]
    got = [f(g).to_pydict() for f, g in zip((look, compare), small, strict=True)]
    monkeypatch.setattr(near, "CELLS", 1 << 30)
    assert got == [f(g).to_pydict() for f, g in zip((look, compare), small, strict=True)] and len(got[1]["x"]) > 200


def test_first_look_rules_out_long_texts_beside_short_ones():
    """Bitmaps of unrelated texts, folded to those of texts a quarter as long, had nearly all bits, so that all long pairs were let through."""
    r, sizes = np.random.default_rng(3), np.array([60] * 20 + [240] * 40)
    lists = [r.integers(0, 1 << 30, n) for n in sizes]
    lists[59] = np.concatenate((lists[58][:225], lists[59][:15]))  # near each other, of different widths
    lists[1] = np.concatenate((lists[0], lists[1][:10]))
    sizes = np.array([len(w) for w in lists])
    off = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    bits, bit_off = near.bitmaps(np.concatenate(lists).astype(np.uint64), off)
    assert len(set(np.diff(bit_off).tolist())) > 2
    group = pa.table({"at": pa.array([near.BOTH] * len(sizes), pa.int32())})
    found = [(x[i], y[j]) for x, y, may in near.open_pairs(group, sizes, bits, bit_off, False, near.SIMILARITY) for i, j in zip(*np.nonzero(may), strict=True)]
    assert len(found) == len(set(found)) and {(0, 1), (58, 59)} <= set(found) and len(found) < 5


def test_near_classes_by_sieve_and_with_repeated_rows_give_the_same(spark, monkeypatch):
    rnd = random.Random(23)
    word = lambda: "".join(rnd.choice("klmnopqrst") for _ in range(5))
    base = [[word() for _ in range(40)] for _ in range(8)]
    texts = [" ".join(w[:i] + w[i + 1 :]) for w in base for i in range(3)]
    df = docs(spark, [*texts, texts[0], "x x x x x"])
    df = df.unionByName(df.where("doc_id in (0, 4, 24)"))
    want = sorted((i, i // 3 * 3) for i in range(24)) + [(24, 0), (25, 25), (0, 0), (4, 3), (24, 0)]
    monkeypatch.setattr(near, "SIEVE", 256)
    for few in (near.BROADCAST_ROWS, 2, 0):
        monkeypatch.setattr(near, "BROADCAST_ROWS", few)
        got = near_classes(df, count_links=False).collect()
        assert sorted((r.doc_id, r.class_id) for r in got) == sorted(want)


def test_near_classes_of_the_fixture_against_brute_force(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if len(r.text or "") < 4000]
    want = brute_classes([r.text for r in rows])
    got = near_classes(docs(spark, [r.text for r in rows]), count_links=False).orderBy("doc_id").collect()
    assert len(set(want)) < len(want)
    assert [r.class_id for r in got] == want


def test_links_of_a_large_family_are_counted(spark):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("klmnopqrst") for _ in range(5))
    base = [word() for _ in range(80)]
    texts = [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(30)]
    rows = near_classes(docs(spark, texts)).collect()
    assert all(r.class_id == 0 and r.n_links == 29 for r in rows)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 30)] + [(40, 41)]])
def test_components(spark, edges):
    got = {r.k: r.label for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: (40 if k >= 40 and len(edges) < 60 else 0) for e in edges for k in e}


# -- 8: decontamination ----------------------------------------------------------------------------


def brute_contamination(texts, items, width=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for k, t in items:
        w = low(t)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(k))
    out = []
    for t in texts:
        w, hit, ids = low(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_contamination_against_brute_force(spark):
    rnd = random.Random(11)
    vocab = ["the", "of", "É", "é", "a1", "x", "yy"]
    say = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(12, None), (13, "THE of, É"), (14, "THE of, É")]
    texts = [say(rnd.randrange(0, 60)) for _ in range(60)] + [i[1] for i in items] + ["-- " + (items[6][1] or "") + " --", None, "", " " * 50, "the " * 2000]
    got = contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.items) for r in got] == brute_contamination(texts, items)
    assert all(r.n_items == len(r.items) and r.contaminated == (r.n_hit > 0) for r in got)


def test_contamination_by_shuffle_join_and_empty_tables(spark, monkeypatch):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    table = docs(spark, ["z a b c d e f g h i j z", "a b c"])
    import shardloom.llm.decontaminate as D

    want = contamination(table, items).orderBy("doc_id").collect()
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert contamination(table, items).orderBy("doc_id").collect() == want
    assert want[0].n_hit == 10 and contamination(table, items.limit(0)).where("contaminated").count() == 0
    assert contamination(docs(spark, []), items).count() == 0


def test_contamination_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (None, "a b c", "y", 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, word string, items int")
    items = spark.createDataFrame([(7, "A b", 3)], "item_id long, text string, at int")
    assert [(r.n_words, r.n_hit, r.items) for r in contamination(table, items).collect()] == [(3, 2, ["7"])] * 3


# -- 10: exact deduplication -----------------------------------------------------------------------


def brute_exact(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(f"[{BLANKS}]", "", t or ""), []).append(i)
    out = {}
    for g in groups.values():
        keep = min(g, key=lambda i: (-len(texts[i] or ""), i))
        for i in g:
            out[i] = (keep, len(g), i == keep)
    return [out[i] for i in range(len(texts))]


EXACT = ["a b", "ab", "a  b ", None, "", " \n", "é😀", "é 😀", "x y", "xy", "a b", "q" * 50_000, "q " * 50_000, "\t\x0b\x0c\r"]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_against_brute_force(spark, weak):
    kw = {"digest": lambda t: F.sha2(F.char_length(t).cast("string"), 256), "files_per_batch": 1} if weak else {"files_per_batch": 1}
    rows = exact_groups(docs(spark, EXACT).repartition(4), **kw).orderBy("doc_id").collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in rows] == brute_exact(EXACT)
    if not weak:
        assert rows[0].digest == hashlib.sha256(b"ab").hexdigest()


def test_exact_groups_by_shuffle_join_give_the_same(spark, monkeypatch):
    import shardloom.llm.exact as X

    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    rows = exact_groups(docs(spark, EXACT)).orderBy("doc_id").collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in rows] == brute_exact(EXACT)


def test_exact_groups_of_odd_tables(spark):
    assert exact_groups(docs(spark, [])).count() == 0
    rows = [(None, "a"), (5, "a"), (5, "a"), (6, "b"), (None, "c")]
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, digest string, n int")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_groups(table).collect())
    assert got == [("5", "5", 3, True), ("5", "5", 3, True), ("6", "6", 1, True), ("None", "5", 3, False), ("None", "None", 1, True)]


@pytest.mark.parametrize("keys", [["b", "a", "c", None], [-(2**63), 5, 2**63 - 1, None]])
def test_exact_groups_take_any_ordered_key(spark, keys):
    kind = "string" if isinstance(keys[0], str) else "long"
    rows = [(k, t) for k, t in zip(keys, ["x y", "xy", " x y", "xy  z z z"], strict=True)] + [(keys[1], "q"), (None, "q ")]
    got = exact_groups(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got if r.group_size == 3} == {(k, keys[2], 3) for k in keys[:3]}
    assert {(r.doc_id, r.keep_id) for r in got if r.group_size == 2} == {(keys[1], None), (None, None)}


def test_exact_groups_meet_rows_of_former_calls(spark, tmp_path):
    state = str(tmp_path / "state")
    first = exact_groups(docs(spark, ["a b", "c", "ab "]), state=state).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in first} == {(0, 0, 2), (2, 0, 2), (1, 1, 1)}
    weak = exact_groups(docs(spark, ["c", " a  b ", "e"], first=10), state=state).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in weak} == {(0, 11, 3), (2, 11, 3), (11, 11, 3), (1, 1, 2), (10, 1, 2), (12, 12, 1)}


# -- 2: licences -----------------------------------------------------------------------------------


def test_licences_found_and_others_left(spark):
    texts = [f"Some prose.\n{t[0]}\nMore prose." for t in licenses.TEMPLATES.values()]
    texts += ["He has a fishing licence for the river.", "All rights reserved. This software is licensed to the customer under a commercial agreement.", None, "", "copyright\n" * 50]
    got = licenses.licence_findings(docs(spark, texts)).where("confirmed").collect()
    assert {(r.doc_id, r.family) for r in got} == set(enumerate(licenses.TEMPLATES)) and all(r.paragraph == 1 and r.coverage == 1 for r in got)


def test_licence_variants_and_repeated_rows(spark):
    near_mit = "permission is hereby granted, free of charge, to any person obtaining copies of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish"
    rows = [(1, near_mit, 0), (1, near_mit, 0), (2, "Licensed under terms and a licence that nobody knows, by permission to use it.", 0)]
    got = licenses.licence_findings(spark.createDataFrame(rows, "doc_id long, text string, gram int")).collect()
    assert [r.family for r in got if r.doc_id == 1] == ["mit", "mit"] and not any(r.confirmed for r in got if r.doc_id == 2)
    assert licenses.licence_findings(docs(spark, [])).count() == 0


def test_licences_without_cue_words_and_over_several_lines(spark):
    wrapped = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction, including\nwithout limitation the rights to use, copy, modify, merge, publish,\ndistribute, sublicense, and/or sell copies of the Software"
    texts = ["Some prose.\nAll rights reserved.\nMore prose.", "This document is provided without warranty of any kind.", f"Some prose.\n \n\n{wrapped}\n\nMore prose."]
    got = licenses.licence_findings(docs(spark, texts)).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got if r.doc_id < 2} == {(0, 1, "unknown"), (1, 0, "unknown")}
    assert [(r.paragraph, r.family, r.template) for r in got if r.doc_id == 2 and r.confirmed] == [(3, "mit", 2)]


def test_licence_scores_equal_the_model(spark):
    m = licenses.fit_licences()
    line = "This work is licensed under the GNU General Public License, version 3."
    z = m.bias + sum(m.weights.get(g, 0) for g in licenses.ngrams(licenses.word_list(line)))
    want = float(np.exp(z / m.temperature).max() / np.exp(z / m.temperature).sum())
    assert abs(licenses.licence_findings(docs(spark, [line])).first().score - want) < 1e-5


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software",
    "gpl-3.0": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.",
    "mpl-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0.",
    "apache-2.0": "# Licensed under the Apache License, Version 2.0 (the License);\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
}


def test_wrapped_notices_are_confirmed(spark):
    texts = [f"Some words before.\n\n{n}\n\nAnd after." for n in NOTICES.values()] + ["word " * 20_000, ""]
    got = {}
    for r in licenses.licence_findings(docs(spark, texts)).where("confirmed").collect():
        got.setdefault(r.doc_id, set()).add(r.family)
    assert got == {i: {f} for i, f in enumerate(NOTICES)}
    assert licenses.licence_findings(docs(spark, [])).count() == 0


def brute_licences(text):
    """Paragraph numbers, families, scores and shares of one text, by sets of n-grams in plain Python."""
    m = licenses.fit_licences()

    def judge(part):
        ws = licenses.word_list(part)
        z = (m.bias + sum((m.weights[g] for g in licenses.ngrams(ws) if g in m.weights), np.zeros(len(m.bias)))) / m.temperature
        guess, score = m.names[int(np.argmax(z))], round(float(1 / np.exp(z - z.max()).sum()), 6)
        two = set(licenses.ngrams(ws, 2))
        shares = [len(b & two) / len(b) for b in (licenses._bigrams(licenses.word_list(t)) for t in licenses.TEMPLATES.get(guess, []))]
        share = max(shares, default=0.0)
        return guess, score, share, guess != licenses.UNKNOWN and score >= licenses.CERTAIN and share >= licenses.COVERED

    out, at = [], 0
    for piece in re.split(r"\n[ \t\r]*(?=\n)", text):
        parts, named = piece.split("\n"), set()
        for i, part in enumerate(parts):
            guess, score, share, stands = judge(part)
            if guess != licenses.NONE:
                out.append((at + i, guess if stands else licenses.UNKNOWN, round(score, 4), round(share, 4)))
                named |= {guess} if stands else set()
        if "\n" in piece.strip(" "):
            guess, score, share, stands = judge(piece)
            if guess != licenses.NONE and stands and guess not in named:
                out.append((at + piece[: len(piece) - len(piece.lstrip())].count("\n"), guess, round(score, 4), round(share, 4)))
        at += len(parts)
    return out


def test_licences_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-i - 1, f"Some words before.\n\n{n}\n\nAnd after.\n{n}") for i, n in enumerate(NOTICES.values())]
    rows += [(-10, "permission is hereby granted\nfree of charge"), (-11, "\n\n \nAll rights reserved.\n"), (-12, "one")]
    got = licenses.licence_findings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((k, *x) for k, t in rows if t for x in brute_licences(t))
    assert [w[:3] for w in want] == sorted((r.doc_id, r.paragraph, r.family) for r in got) and len(want) > 5
    for w, g in zip(want, sorted((r.doc_id, r.paragraph, r.family, r.score, r.coverage) for r in got)):
        assert abs(w[3] - g[3]) < 1e-3 and abs(w[4] - g[4]) < 1e-3


# -- 9: secrets ------------------------------------------------------------------------------------


def test_secrets_on_held_out_findings(spark):
    rows = secrets.labelled_findings(seed=99, each=12)
    table = docs(spark, [b + v + a for b, v, a, _ in rows])
    got = {(r.doc_id, r.value_sha256): r for r in secrets.secret_findings(table).collect()}
    right = wrong = missed = 0
    for i, (_, v, _, y) in enumerate(rows):
        r = got.get((i, hashlib.sha256(v.encode()).hexdigest()))
        if r is None:
            missed += y
        else:
            right, wrong = right + (r.secret == bool(y)), wrong + (r.secret != bool(y))
    assert right / (right + wrong) > 0.95 and missed / sum(y for *_, y in rows) < 0.1


def test_every_labelled_secret_is_a_candidate(spark):
    rows = [(b, v, a) for b, v, a, y in secrets.labelled_findings(seed=98, each=12) if y]
    named = [("DB_PASSWORD=", "aB3!xY7@kQ9#mZ"), ("password: ", "tr0ub4dor&3"), ("secret=", "Zx9kQ2mW7r"), ("password=", "CorrectHorseBatteryStaple"), ('{"api_key": "', "a.b-" * 38)]
    rows += [(b, v, '"' if b.endswith('"') else "") for b, v in named]
    got = {(r.doc_id, r.value_sha256) for r in secrets.secret_findings(docs(spark, [b + v + a for b, v, a in rows])).collect()}
    assert [r for i, r in enumerate(rows) if (i, hashlib.sha256(r[1].encode()).hexdigest()) not in got] == []


def test_secret_positions_and_odd_texts(spark):
    token = hashlib.sha1(b"x").hexdigest()
    texts = [f'é😀 token = "{token}" x', None, "", "a" * 5000, " ".join(hashlib.sha1(str(i).encode()).hexdigest() for i in range(150)), f"commit {token} fixed"]
    table = docs(spark, texts)
    rows = secrets.secret_findings(table).collect()
    for r in rows:
        assert hashlib.sha256(texts[r.doc_id][r.position : r.position + r.length].encode()).hexdigest() == r.value_sha256
    assert sum(r.doc_id == 4 for r in rows) == 150
    assert {r.secret for r in rows if r.doc_id == 0} == {True} and {r.secret for r in rows if r.doc_id == 5} == {False}
    assert secrets.secret_findings(docs(spark, [])).count() == 0


def test_places_of_many_candidates(spark):
    text = " ".join(f"password={i:05d}abcXYZ" for i in range(700))
    rows = secrets.secret_findings(spark.createDataFrame([(1, text, "x"), (1, text, "x")], "doc_id long, text string, score string")).collect()
    assert sorted(r.position for r in rows) == sorted(2 * [m.start(1) for m in re.finditer(r"=(\S+)", text)])


def test_trees_as_sql_equal_the_trees(spark):
    trees = secrets.train_forest(spark)
    names = [n for n, _ in secrets.features(F.lit(""), F.lit("x"), F.lit(""))]
    rnd = random.Random(3)
    rows = [tuple(rnd.choice([0.0, 0.3, 1.0, 20.0]) for _ in names) for _ in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(*(F.expr(secrets.as_sql(t, names)).alias(f"t{i}") for i, t in enumerate(trees[:5])))

    def walk(t, x):
        while not isinstance(t, float):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        return t

    for r, x in zip(df.collect(), rows, strict=True):
        assert np.allclose(list(r), [walk(t, x) for t in trees[:5]], atol=1e-6)

"""Packing, decontamination, fingerprints, language and quality against brute force and held-out rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskloom.llm import decontamination, language, packing, quality, queries, simhash
from riskloom.llm.runs import roots

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LONG = "word " * 60_000


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pandas()


def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and columns whose names clash with inner ones."""
    rows = [(1, None, "en", 1), (2, "", "en", 2), (3, "  \n\t ", None, 3), (4, LONG, "en", 4), (5, "Same text here", "en", 5), (5, "Same text here", "en", 5),
            (None, "no id at all", "fr", 6), (7, "1234 !!", None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rid long").withColumn("id", F.lit("x")).withColumn("fp", F.lit(0)) \
        .withColumn("found", F.lit("y")).withColumn("kind", F.lit("z")).withColumn("word", F.lit(1))


# ------------------------------------------------------------------- packing


def test_open_bins_fill_best_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0)   # 4 left
    assert bins.place(7) == (1, 0)   # 3 left
    assert bins.place(3) == (1, 7)   # the least room that holds it; full now
    assert bins.place(8) == (2, 0)   # 2 left
    assert bins.place(9) == (3, 0)   # a third open bin: the fullest of 0 and 2 closes
    assert bins.place(2) == (0, 6)   # bin 2 is closed
    assert bins.open == 2
    with pytest.raises(ValueError):
        bins.place(11)


def test_run_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(packing.default_tokenizer()), packing.RunEncoder(packing.default_tokenizer(), remembered=20)
    texts = ["It's DON'T.", "<|endoftext|> x<|ENDOFTEXT|>", "…!\x0bword…, a_b", "étÉ \x85q \x1cz İ Å", "", "a,b.c!! 12,345. ###abc&&&"] * 3
    got = [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in texts])]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def check_packed(got, texts):
    from tokenizers import Tokenizer

    ids = {k: e.ids + [1] for k, e in zip(texts, Tokenizer.from_file(packing.default_tokenizer()).encode_batch(
        [t or "" for t in texts.values()], add_special_tokens=False))}
    for r in got.itertuples():
        part = ids[r.doc_id][r.start: r.start + r.length]
        assert r.start == 4096 * r.piece and r.length == len(part) and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert got.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 4096
    return -(-sum(map(len, ids.values())) // 4096)


def test_packing_whole_table(spark):
    d = documents()
    got = queries.QUERIES["op6_best_fit_packing"](spark, SF).toPandas()
    least = check_packed(got, dict(zip(d.doc_id, d.text)))
    assert got.sequence_id.nunique() <= least * 1.03 + 1


def test_packing_odd_rows(spark):
    d = odd_docs(spark)
    got = packing.pack(d).toPandas()
    assert len(got[got.doc_id.isna()]) == 1 and len(got[got.doc_id == 5]) == 2
    assert got[got.doc_id.isin([1, 2, 3])].length.tolist() == [1, 1, 1]
    assert got[got.doc_id == 4].length.sum() == 60_001
    assert packing.pack(d.limit(0)).count() == 0


# ---------------------------------------------------------- decontamination


def brute_windows(docs, items):
    windows = {}
    for item, text in items:
        w = WORDS.findall(lower(text or ""))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s: s + n]), set()).add(item)
    out = []
    for key, text in docs:
        w = WORDS.findall(lower(text or ""))
        hit, found = set(), set()
        for n in {len(p) for p in windows}:
            for s in range(len(w) - n + 1):
                if who := windows.get(tuple(w[s: s + n])):
                    found |= who
                    hit |= set(range(s, s + n))
        listed = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((key, len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_whole_table(spark):
    d, b = documents(), pq.read_table(f"{SF}/benchmark.parquet").to_pandas()
    got = queries.QUERIES["op4_decontamination"](spark, SF).collect()
    want = brute_windows(zip(d.doc_id, d.text), zip(b.item_id, b.text))
    assert sorted(map(tuple, got)) == sorted(want) and any(w[-1] for w in want)


@pytest.mark.parametrize("block_chars", [1 << 20, 40])
def test_decontamination_odd_rows_in_one_and_many_blocks(spark, block_chars):
    items = [(1, "Same text"), (2, "one two three four five six seven eight nine ten eleven"), (2, "one two three four five six seven eight nine ten eleven"),
             (3, None), (4, "..."), (None, "no id"), (10, "same TEXT"), (11, "word word word word word word word word word word word")]
    docs = [(1, None), (2, ""), (3, "x one-two three, four five six seven eight NINE ten eleven"), (4, "word " * 500), (5, "the same text, same"),
            (5, "the same text, same"), (None, "has no id"), (6, "one two three four five six seven eight nine elf ten")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontamination.find_windows(d, spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars).drop("text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_windows(docs, items), key=repr)


def test_decontamination_empty_tables_and_other_columns(spark):
    d = odd_docs(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(d, none).count() == d.count()
    some = spark.createDataFrame([(1, "same text here")], "item_id long, text string")
    kept = decontamination.decontaminate(d, some)
    assert kept.columns == d.columns and kept.count() == d.count() - 2
    assert decontamination.find_windows(d.limit(0), some).count() == 0


# ------------------------------------------------------------------- simhash


def brute_print(text, words=3):
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    shingles = [" ".join(w[i: i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    many = Counter(k for s in shingles for k in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> k & 1)
    return sum(1 << k for k in range(64) if 2 * many[k] > len(shingles))


def brute_groups(prints):
    """Smallest id that each id reaches."""
    ids, fps = zip(*prints)
    fps = np.array(fps, np.uint64)
    near, label = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, np.array(ids)
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return dict(zip(ids, label.tolist()))
        label = new


def test_simhash_whole_table(spark):
    d = documents()
    prints = [(i, brute_print(t)) for i, t in zip(d.doc_id, d.text)]
    group = brute_groups(prints)
    got = queries.QUERIES["op8_simhash_near_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{p:016x}", group[i]) for i, p in prints)


@pytest.mark.parametrize("many", [300, 1500])
@pytest.mark.parametrize("bits, shared", [(2, (3, 4, 5, 6, 7)), (1, (2, 3, 4, 5, 6, 7))])
def test_simhash_posting(many, bits, shared):
    """The count filter drops pairs and loses none; a split posting links the same."""
    free = np.random.default_rng(3).integers(0, 1 << 8 * (8 - len(shared)), many).astype(np.uint64)
    group = np.unique(np.uint64(0x0123456789ABCDEF) ^ free)
    i, j = np.triu_indices(len(group), 1)
    near = np.bitwise_count(group[i] ^ group[j]) <= bits
    want = roots(len(group), i[near], j[near])
    counted = set(zip(*(x.tolist() for x in simhash._counted(group, bits))))
    assert len(counted) < len(i) / 20 and counted >= set(zip(i[near].tolist(), j[near].tolist()))
    assert (roots(len(group), *simhash._verified(group, bits)) == want).all()
    assert (simhash._split(group, shared, bits) == want).all()


def test_simhash_links_chains_and_large_postings(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base[:10] for i, j in rng.integers(0, 62, (60, 2))]
    fps = sorted({int(x) for x in base} | {int(x) for x in near})
    d = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r.fp: r.root for r in simhash.groups(d).collect()}
    want = brute_groups([(f, f) for f in fps])
    assert len(got) == len(fps)
    assert {frozenset(k for k in got if got[k] == r) for r in set(got.values())} == \
        {frozenset(k for k in want if want[k] == r) for r in set(want.values())}


def test_one_per_group_and_odd_rows(spark):
    d = odd_docs(spark)
    kept = simhash.one_per_group(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 5, 7, None]  # 1, 2 and 3 have no words
    got = simhash.near_duplicates(d).collect()
    assert len(got) == d.count() and [r.component_id for r in got if r.doc_id is None] == [None]
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16} and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(d.limit(0)).count() == 0 and simhash.one_per_group(d.limit(0)).count() == 0


# ------------------------------------------------------- language and quality


def test_language_held_out(spark):
    d = documents().set_index("doc_id")
    got = queries.QUERIES["op2_language_id"](spark, SF).toPandas()
    assert len(got) == len(d) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred.values == d.loc[held.doc_id, "lang"].values).mean() > 0.95


def test_language_counts_equal_brute_force(spark):
    from riskloom.llm.ngrams import blocks, char_grams

    text = "abc " * 50 + "xyz"
    whole = [char_grams(p, s, 3, 15) for p, s, _ in blocks([text, "", "ab"], 2)]
    cut = [char_grams(p, s, 3, 15) for p, s, _ in blocks([text, "", "ab"], 2, size=16)]
    count = lambda x: Counter(b for part in x for b in part.tolist() if b < 1 << 15)
    assert count(whole) == count(cut) and sum(count(whole).values()) == len(text) - 2


def test_language_odd_rows(spark):
    d = odd_docs(spark)
    model = language.train(d)
    assert model.languages == ["en", "fr"]
    got = language.identify(d, model).toPandas()
    assert got[got.text.isna() | got.text.isin(["", "  \n\t ", "1234 !!"])].lang_pred.eq("und").all()
    assert got[got.doc_id.isna()].lang_pred.tolist() == ["fr"] and got[got.doc_id == 4].lang_pred.tolist() == ["en"]
    assert got[got.doc_id == 5].lang_pred.nunique() == 1 and len(got) == 8
    kept = language.known_language_only(d)
    assert kept.columns == d.columns and kept.count() == 4
    none = language.train(d.limit(0))
    assert set(language.identify(d, none).toPandas().lang_pred) == {"und"}


def test_quality_held_out(spark):
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas().set_index("doc_id")
    got = queries.QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    told = got.join(labels, how="inner")
    told = told[told.held_out]
    assert (told.predicted == told.quality).mean() > 0.93
    assert told[told.quality == 1].score.median() > told[told.quality == 0].score.median()


def test_quality_odd_rows(spark):
    model = quality.fit(["good fine words", "bad bad bad bad"] * 20, [1, 0] * 20)
    assert quality.probability(model, "good fine words") > 0.5 > quality.probability(model, "bad bad bad bad")
    assert quality.probability(model, None) == quality.probability(model, "") == quality.probability(model, " \n")
    assert quality.probability(quality.fit([], []), "x") == 0.5 and quality.probability(quality.fit(["x"], [1]), "y") > 0.99
    d = odd_docs(spark)
    assert quality.score(d, model).count() == d.count() and quality.score(d.limit(0), model).count() == 0
    labels = spark.createDataFrame([(5, 1), (5, 0), (5, 1), (4, 0), (None, 1), (1, None)], "doc_id long, quality int")
    assert quality.train(d, labels).lean.any()  # the labelled texts are the longest ones
    assert not quality.train(d, labels, sample_features=1).lean.any()
    names = spark.createDataFrame([(k, "good fine words" if k % 2 else "bad bad bad") for k in range(8)], "doc_id long, text string")
    told = names.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    assert (quality.train(names, told).lean == quality.fit(*zip(*[(r.text, r.doc_id % 2) for r in names.orderBy("doc_id").collect()])).lean).all()


def test_results_replace_columns_of_their_names(spark):
    d = odd_docs(spark)
    for name in ("lang_pred", "score", "n_words", "spans", "contaminated", "letter", "_letter", "found_items"):
        d = d.withColumn(name, F.lit("old"))
    items = spark.createDataFrame([(1, "same text here")], "item_id long, text string")
    assert {r.contaminated for r in decontamination.find_windows(d, items).collect()} == {True, False}
    assert decontamination.decontaminate(d, items).columns == d.columns
    model = language.train(d)
    assert "old" not in {r.lang_pred for r in language.identify(d, model).collect()}
    assert language.known_language_only(d).columns == d.columns
    assert all(0 <= r.score <= 1 for r in quality.score(d, quality.fit(["a"], [1])).collect())

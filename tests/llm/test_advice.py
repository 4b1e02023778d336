"""The whole job of each operator where a review found less of it."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import cotrain, notices, postings, queries, surrogates, wavelet
from quernstone.llm.common import shared_folder


# 9: decontamination


def brute_near(text, item, slop):
    from collections import Counter

    words, passage = (postings.alnum_words(t) for t in (text, item))
    n = min(postings.WINDOW, len(passage))
    return any(
        not Counter(passage[a : a + n]) - Counter(words[b : b + n + slop]) for a in range(len(passage) - n + 1) for b in range(max(1, len(words) - n - slop + 1))
    )


def test_query_has_proximity_matches(spark, tmp_path):
    passage = [f"w{i}" for i in range(13)]
    texts = [
        passage, [*passage[:6], "new", *passage[6:]], [passage[1], passage[0], *passage[2:]], [*passage[:6], *["z"] * 8, *passage[6:]],
        [*passage[:6], *["z"] * 7, *passage[6:]], passage[1:], [*passage[1:7], *["z"] * 7, passage[0], *["z"] * 7, *passage[7:]],
    ]
    docs = [(i, "pad pad " + " ".join(t)) for i, t in enumerate(texts)]
    items = [(1, " ".join(passage)), (2, "w1 w1 w2")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op9_exact_and_near"](spark, str(tmp_path)).collect()}
    for d, t in docs:
        assert got[d].near == [str(i) for i, item in items if brute_near(t, item, postings.SLOP)] and got[d].n_near == len(got[d].near)
    assert [got[d].n_near for d in range(7)] == [1, 1, 1, 0, 1, 0, 0]
    plain = queries.QUERIES["op9_decontamination"](spark, str(tmp_path))
    assert sorted(map(tuple, plain.collect())) == sorted(tuple(r)[:5] + (r.contaminated,) for r in got.values())


def test_near_positions_like_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(200):
        text, item = ([f"w{x}" for x in rng.integers(0, 5, n)] for n in (40, 4))
        spelled = sorted(set(text))
        code = np.array([spelled.index(w) for w in text])
        index = postings.ShardIndex([w.encode() for w in spelled], np.concatenate([[0], np.cumsum(np.bincount(code))]), np.argsort(code, kind="stable"))
        if set(item) <= set(spelled):
            assert (len(index.near([spelled.index(w) for w in item], 4)) > 0) == brute_near(" ".join(text), " ".join(item), 1)


# 6: surrogates


def test_ibans_that_differ_in_check_digits_alone(spark):
    forms = ["DE89 3704 0044 0532 0130 00", "DE98 3704 0044 0532 0130 00", "AB12 3456 7890 1234 5678", "AB13 3456 7890 1234 5678"]
    rows = [(i, f"to {f} please") for i, f in enumerate(forms)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert surrogates.collisions(df, b"key") == 0
    got = {r.doc_id: r for r in surrogates.pseudonymize(df, b"key").collect()}
    made = [got[i].spans[0].surrogate for i in range(4)]
    assert len(set(made)) == 4 and not set(made) & set(forms)
    right = [surrogates.check_digits(m[:2], m.replace(" ", "")[4:]) == m[2:4] for m in made]
    assert right == [True, False, False, False]


def test_iban_surrogates_are_a_permutation():
    made = surrogates.Surrogates(b"k")
    for tail in ("12", "0A"):
        every = [f"AB{c:02d}{tail}" for c in range(100)] if tail == "0A" else [f"AB{c:02d}{b:02d}" for c in range(100) for b in range(100)]
        got = [made.iban(f) for f in every]
        assert len(set(got)) == len(every) and (tail == "0A" or set(got) == set(every))


@pytest.mark.parametrize("text, names", [
    ("So Mr Kowalski went", ["Kowalski"]), ("ask Dr. Nguyen.", ["Nguyen"]), ("by Robert Jones, 1999", ["Robert", "Jones"]), ("Prof. Dr. Jean-Luc O'Brien spoke", ["Jean", "Luc", "Brien"]),
    ("Frau Müller-Lüdenscheidt kam", ["Müller", "Lüdenscheidt"]), ("Mrs Smithson and Miss Smith-Jones", ["Smithson", "Smith", "Jones"]), ("пришла Анна Новикова", ["Анна", "Новикова"]),
    ("Señor Juan de la Cruz vino", ["Juan", "Cruz"]), ("Mr Kowalski's hat", ["Kowalski"]), ("Г-н Новиков ушёл", ["Новиков"]),
])
def test_unlisted_names_are_replaced(text, names):
    made = surrogates.Surrogates(b"k2")
    new, spans = surrogates.replace(text, made)
    left = surrogates.WORD.findall(new)
    assert spans and not set(names) & set(left), new
    assert [len(w) for w in text.split()] == [len(w) for w in new.split()] or any(n in made.cycle for n in names)
    assert surrogates.replace("and " + text, made)[0] == "and " + new


def test_unlisted_names_stay_distinct_and_agree():
    made = surrogates.Surrogates(b"k")
    every = [a + b + c for a in "BCDFGLS" for b in "aeiou" for c in ("", "n", "ns", "nna")] + ["Anna", "Paul", "Emma"]
    assert len({made.person("Mr " + n) for n in every}) == len(every)
    assert made.person("Dr. Robert Kowalski").split()[-1] == made.person("Mr Kowalski").split()[-1]
    m, f = made.person("Г-н Новиков"), made.person("Г-жа Новикова")
    assert f == m.replace("Г-н", "Г-жа") + "а"
    for text in ("Anna went home", "the mister and Paul. The end", "Doctor No", "x"):
        assert surrogates.detect(text) == []


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789 .+-()/@:ABDE89\nmrMrDx", max_size=60))
def test_no_text_stops_the_job(text):
    made = surrogates.Surrogates(b"k")
    new, spans = surrogates.replace(text, made)
    assert (new == text) or spans


def test_entities_stay_apart_whatever_their_form():
    """No two entities of a kind share a surrogate, over many forms at once."""
    rng, made = np.random.default_rng(8), surrogates.Surrogates(b"k")
    forms = ["+49 ddd ddddddd", "0dd-dddddd", "(ddd) ddd-dddd", "ddd-dd-dddd", "dddd dddd dddd dddd", "DEdd dddd dddd dddd dd", "d.d.d.d", "add@bdd.org", "Mr Xaa"]
    pool = {"d": "0123456789", "a": "abc", "b": "xyz"}
    told: dict = {}
    for form in forms * 300:
        text = "see " + "".join(str(rng.choice(list(pool[c]))) if c in pool else c for c in form) + " ."
        new, spans = surrogates.replace(text, made)
        for kind, a, b, surrogate in spans:
            old = surrogates.canonical(kind, text[a:b])
            assert told.setdefault((kind, surrogates.canonical(kind, surrogate)), old) == old
    assert len({k for k, _ in told}) >= 6


def test_leaders_are_no_phone():
    assert surrogates.detect("see +1 .......... 5\nand 123") == []


# 1: token ids


ADDED = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|>b  c", "plain text, here", "say <|endoftext|>. <|endoftext|> x", "<|endof text|>"]


def test_added_tokens_like_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(wavelet.vocabulary())
    want, start = [], 0
    for d, text in enumerate(ADDED):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    df = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    assert sorted(map(tuple, wavelet.token_output(df, wavelet.vocabulary(), shared_folder(spark, "t")).collect())) == want
    assert t.encode(ADDED[0], add_special_tokens=False).ids == [3826, 220, 50256, 994]


# 10: licenses


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_notices(text):
    """(label, first word, last word, edits), the best of those of a notice that overlap."""
    words, found = [w.decode() for w in notices.alnum_words(text)], set()
    for phrase, label, edits in notices.NOTICES:
        spans = []
        for a in range(len(words)):
            for b in range(a, len(words)):
                part = " ".join(words[a : b + 1])
                if abs(len(part) - len(phrase)) <= edits and (e := distance(part, phrase)) <= edits:
                    spans.append((e, a, b))
        taken = []
        for e, a, b in sorted(spans):
            if all(b < x or y < a for x, y in taken):
                taken.append((a, b))
                found.add((a, b, label, e))
    return [f"{label}:{a}:{b}:{e}" for a, b, label, e in sorted(found)]


@pytest.mark.parametrize("text, want", [
    ("redistribution and use in source and binary forms, with or without modifications are permitted", "bsd:0:11:1"),
    ("the GNU General Public Licenses apply", "gpl:1:4:1"),
    ("sublicensed under the apache license version 2 0", "apache-2.0:0:7:3"),
    ("all rights reservd overall rights reserved here", "reserved:0:2:1"),
    ("all rights reserved all rights reservd; al rights reserved", "reserved:3:5:1"),
    ("licensed under cc by licenced under cc-by", "cc-by:4:7:1"),
])
def test_whole_word_notices_within_their_edits(text, want):
    spans = notices.NoticeScanner().scan(text)[-1]
    assert want in spans and spans == brute_notices(text)


def test_notices_like_brute_force():
    rng, scanner = np.random.default_rng(10), notices.NoticeScanner()
    for _ in range(150):
        text = list(" ".join(notices.NOTICES[i][0] for i in rng.integers(0, len(notices.NOTICES), 2)))
        for _ in range(rng.integers(0, 5)):
            at = int(rng.integers(0, len(text)))
            text[at : at + int(rng.integers(0, 2))] = str(rng.choice(["", "s", " ", "xy"]))
        assert scanner.scan("".join(text))[-1] == brute_notices("".join(text)), "".join(text)


# 2: co-training


@pytest.mark.parametrize("toxic", [0, 1])
def test_no_toxicity_told_without_a_model(spark, toxic):
    docs = spark.createDataFrame([(i, f"some plain text {i}") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, toxic) for i in range(6)], "doc_id long, quality int, toxic int")
    got = cotrain.classify(docs, labels, targets=("quality", "toxic")).collect()
    assert len(got) == 8 and all(r.is_quality is True and r.is_toxic is None and r.p_toxic is None for r in got)


def test_models_are_fitted_in_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text number {i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    feats = cotrain.stored(cotrain.features(docs), "features")

    def unpack(batch):
        raise AssertionError("the driver unpacks features")

    monkeypatch.setattr(cotrain, "unpack", unpack)
    assert cotrain.train(feats, labels, rounds=0)["quality"] is not None

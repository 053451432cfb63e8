"""Leakage search against brute force; language identification on held-out and spoiled text."""

import math
import random
import unicodedata

import numpy as np
import pytest

from questlake.llm import language, leakage
from questlake.llm.language import Identifier, languages_of, repaired
from questlake.llm.leakage import Searcher
from questlake.llm.words import words
from questlake.sources.ods import table

DATA = "/root/testdata/sf0.001"


def test_words_ignore_case_accents_and_invisible_characters():
    assert words("Straße, CAFÉ​ noir; na­ïve été x_y 42﻿") == ["strasse", "cafe", "noir", "naive", "ete", "x", "y", "42"]
    assert words(None) == words("") == words(" … – !") == []
    assert words("ＦＵＬＬ ﬁn Ёлка й") == ["full", "fin", "елка", "и"]


def brute(text, passage):
    w, p = words(text), words(passage)
    n = len(p)
    if not n:
        return False
    grams = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    if any(tuple(p[i : i + 10]) in grams for i in range(n - 9)):
        return True
    need, reach = math.ceil(0.75 * n - 1e-9), math.floor(1.5 * n + 1e-9)
    for s in range(len(w)):
        row = [0] * (n + 1)
        for x in w[s : s + reach]:
            prev = row
            row = [0]
            for j, y in enumerate(p):
                row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        if row[n] >= need:
            return True
    return False


def test_search_equals_brute_force_at_the_borders():
    rng = random.Random(7)
    common = [f"w{i}" for i in range(12)]
    for trial in range(120):
        n = rng.choice((1, 3, 9, 10, 11, 20, 37))
        passages = [" ".join(rng.choice([*common, f"n{rng.randrange(300)}"]) for _ in range(n)) for _ in range(4)]
        body = []
        for p in passages:
            w = p.split()
            keep = sorted(rng.sample(range(n), max(0, min(n, math.ceil(0.75 * n) + rng.choice((-1, 0, 0, 1))))))
            out = []
            for i in keep:
                out += [w[i]] + ["filler"] * (rng.random() < rng.choice((0, 0.5, 0.95)))
            if rng.random() < 0.3 and n > 10:
                a = rng.randrange(n - 9)
                out = w[a : a + rng.choice((9, 10))]
            body += out + [rng.choice(common)] * rng.randrange(4)
        text = " ".join(body)
        got = {r[0] for r in Searcher(list(enumerate(passages))).search(text)}
        assert got == {k for k, p in enumerate(passages) if brute(text, p)}, (trial, n)


def test_leaked_items_frame(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(1, passage, "x"), (2, None, "x"), (3, "", "x"), (4, "other thing entirely", "x")], "item_id bigint, passage string, doc_id string")
    docs = spark.createDataFrame([(10, "intro " + passage.upper() + " end", "c"), (10, passage, "c"), (11, None, "c"), (12, "", "c"), (13, "x " * 200_000 + passage, "c"), (14, " ".join(passage.split()[:9]), "c")], "doc_id bigint, text string, item_id string")
    for block in (20_000, 1):
        rows = leakage.leaked_items(docs, items, block=block).collect()
        assert sorted((r.item_id, r.doc_id, r.rule, r.matched_words) for r in rows) == [(1, 10, "edit", 30), (1, 13, "edit", 30)]
    assert leakage.leaked_items(docs.limit(0), items).count() == 0 and leakage.leaked_items(docs, items.limit(0)).count() == 0


def brute_distance(pattern, text):
    row, best = list(range(len(pattern) + 1)), len(pattern)
    for x in text:
        prev, row = row, [0]
        for j, y in enumerate(pattern):
            row.append(min(prev[j] + (x != y), prev[j + 1] + 1, row[j] + 1))
        best = min(best, row[-1])
    return best


def test_edit_distance_equals_the_table():
    rng = random.Random(11)
    for _ in range(60):
        passage = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 90))]
        item = Searcher([(1, " ".join(passage))]).items[0]
        numbers = Searcher([(1, " ".join(passage))]).vocabulary
        text = [rng.choice(passage) if rng.random() < 0.7 else "other" for _ in range(rng.randrange(0, 120))]
        distance, end = leakage.edit_distance(item, np.array([numbers.get(x, -1) for x in text], np.int64))
        assert distance == brute_distance(passage, text) and brute_distance(passage, text[:end]) == distance


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 24, 41, 102])
def test_pairs_stand_the_worst_errors(n):
    """Missing words that each break a pair and words between that push pairs apart: the sure number of hits is left."""
    passage = [f"p{i}" for i in range(n)]
    searcher = Searcher([(1, " ".join(passage))])
    item, rng = searcher.items[0], random.Random(n)
    for _ in range(60):
        gone = set(rng.sample(range(0, n, 2), min(item.budget, (n + 1) // 2))) if n > 1 else set()
        kept, spare = [w for i, w in enumerate(passage) if i not in gone], item.reach - (n - len(gone))
        text = []
        for w in kept:
            text.append(w)
            put = min(spare, rng.choice((0, leakage.GAP + 1)))
            text += ["x"] * put
            spare -= put
        assert [r[0] for r in searcher.search(" ".join(["y"] * 200 + text + ["y"] * 200))] == [1], text


def test_every_row_names_a_piece_that_stands_there(spark):
    docs, items = table(spark, DATA, "documents"), table(spark, DATA, "eval_items")
    texts = {r.doc_id: words(r.text) for r in docs.select("doc_id", "text").collect()}
    passages = {r.item_id: words(r.passage) for r in items.select("item_id", "passage").collect()}
    rows = leakage.leaked_items(docs, items).collect()
    assert rows
    for r in rows:
        text, passage = texts[r.doc_id][r.text_place :], passages[r.item_id][r.piece_place : r.piece_place + r.piece_words]
        assert text[: r.piece_words] == passage if r.piece_words > 2 else text[0] == passage[0] and passage[-1] in text[: leakage.GAP + 2]


@pytest.fixture(scope="module")
def samples(spark):
    return [(r.lang, r.text) for r in table(spark, DATA, "lang_samples").select("lang", "text").orderBy("sample_id").collect()]


def without_accents(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


@pytest.mark.parametrize("spoil", [str, str.upper, without_accents, lambda t: t[: len(t) // 2], lambda t: repaired(t.encode().decode("latin-1")), lambda t: repaired(t.encode().decode("cp1252", "ignore")) + " " + t])
def test_held_out_accuracy(samples, spoil):
    by = {}
    for lang, text in samples:
        by.setdefault(lang, []).append(text)
    identify = Identifier([(lang, t) for lang, ts in by.items() for t in ts[:100]])
    held = [(lang, spoil(t)) for lang, ts in by.items() for t in ts[100:]]
    right = sum([x[0] for x in languages_of(s)] == [lang] for (lang, _), s in zip(held, identify.segments_of([t for _, t in held])))
    assert right / len(held) >= 0.96


def test_mixed_texts_are_cut_where_they_change(samples):
    by = {}
    for lang, text in samples:
        by.setdefault(lang, []).append(text)
    identify = Identifier([(lang, t) for lang, ts in by.items() for t in ts[:100]])
    rng, right = random.Random(3), 0
    for _ in range(60):
        a, b = rng.sample(sorted(by), 2)
        one, two = " ".join(rng.sample(by[a][100:], 3)), " ".join(rng.sample(by[b][100:], 3))
        found = identify.segments(one + " " + two)
        right += [s.lang for s in found] == [a, b] and abs(found[1].start - len(one)) <= 3
        assert found[0].start == 0 and found[-1].end == len(one) + 1 + len(two) and all(x.end == y.start for x, y in zip(found, found[1:]))
        assert all(0 < s.confidence <= 1 for s in found)
    assert right >= 56


def test_parsing_in_step_equals_parsing_one_by_one(samples):
    identify = Identifier(samples)
    pieces = [language.plain(t) for _, t in samples[::20]] + ["q", "ß", "年", "xyzzy " * 300, "ελλη"]
    identify.learn(pieces)
    for p in pieces:
        text = p if language._script(p[0]) == 2 else f" {p} "
        for a, dense in zip(identify.forward, identify._dense):
            if dense is not None:
                import numpy as np

                codes = identify._code[[ord(c) for c in text]]
                assert dense.phrases(codes, np.array([0]), np.array([len(text)]))[0] == a.phrases(text)


def test_share_decides_what_is_mixed():
    seg = lambda lang, n: language.Segment(0, 1, lang, 1.0, n)
    assert [x[0] for x in languages_of([seg("en", 85), seg("de", 15)])] == ["en", "de"]
    assert [x[0] for x in languages_of([seg("en", 86), seg("de", 14)])] == ["en"]
    assert languages_of([]) == []


def test_labels(spark):
    from pyspark.sql import functions as F

    rows = [("EN", "en"), (" en_GB ", "en"), ("English", "en"), ("eng", "en"), ("zh-Hans-CN", "zh"), ("PORTUGUESE (Brazil)", "pt"), ("deu", "de"), ("ger", "de"), ("und", None), ("", None), (None, None), ("nl", None), ("??", None), ("ended", None)]
    got = spark.createDataFrame(rows, "l string, want string").select(language.label_language(F.col("l")).alias("x"), "want").collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_languages_frame(spark):
    samples = table(spark, DATA, "lang_samples")
    text = "We think that the gardener carries the garden gate in the morning."
    docs = spark.createDataFrame([(1, text, "de", 0.5), (1, text, "en", 0.5), (2, None, "en", 0.5), (3, "", None, 0.5), (4, "123 : 456 № 7", "en", 0.5), (5, text * 3000, None, 0.5)], "doc_id bigint, text string, lang string, confidence_in double")
    rows = language.languages(docs, samples, keep=["lang"]).collect()
    assert sorted((r.doc_id, r.lang or "", r.found_lang, r.mixed) for r in rows) == [(1, "de", "en", False), (1, "en", "en", False), (5, "", "en", False)]
    assert language.segments(docs.limit(0), samples).count() == 0

"""Decontamination against a plain search for windows."""

import random
import re

import numpy as np
import pytest

from spanloom.llm import decontamination as D

LETTERS = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def fold(text):
    return re.findall(LETTERS, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(text, items, window=10):
    said, hit, found = fold(text), set(), set()
    for name, item in items:
        ws = fold(item)
        if not ws:
            continue
        size = min(window, len(ws))
        wins = {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}
        for i in range(len(said) - size + 1):
            if tuple(said[i : i + size]) in wins:
                found.add(str(name))
                hit |= set(range(i, i + size))
    return len(said), len(hit), sorted(found)


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = ["Ab", "c'd", "éa", "7x", "zz", "Qu", "İ", "mn"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "  "]) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 9, 10, 11, 40]))) for i in range(40)] + [(40, ""), (41, None), (7, say(20)), (42, "...")]
    docs = []
    for i in range(120):
        t = say(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            ws = re.findall(r"\S+", rng.choice(items)[1] or "")
            at = rng.randrange(len(ws) + 1)
            t += " " + " / ".join(w.upper() if w.isascii() else w for w in ws[at : at + rng.choice([5, 10, 30])]) + " " + say(rng.randrange(9))
        docs.append((i, t))
    return docs, items


@pytest.mark.parametrize("most", [10**6, 100])
def test_windows_found(spark, most):
    docs, items = texts()
    d = spark.createDataFrame([*docs, (500, None), (501, ""), (3, docs[3][1]), (None, docs[4][1])], "doc_id long, text string")
    got = D.contamination(d, spark.createDataFrame(items, "item_id long, text string"), most=most).collect()
    assert len(got) == d.count()
    by_id = dict(docs) | {500: None, 501: "", None: docs[4][1]}
    for r in got:
        n, hits, found = plain(by_id[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hits, found), r
        assert r["contaminated"] == (hits > 0) and r["n_items"] == len(found)
        inside = [by_id[r["doc_id"]][int(a) : int(b)] for a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert sum(len(fold(s)) for s in inside) == hits
    assert {r["contaminated"] for r in got} == {True, False}


def test_spans_lie_on_the_original():
    text = "Say: ONE, two;\nthree—Four!  rest"
    hit = np.array([False, True, True, True, False])
    said = D.words(text)
    assert [w.decode() for w in said] == ["say", "one", "two", "three—four", "rest"]
    assert [text[a:b] for a, b in D.spans(text, hit)] == ["ONE, two;\nthree—Four"]


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y")], "doc_id long, text string, runs string, items string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["contaminated"]) for r in D.contamination(docs, none).collect()] == [(3, False)]
    bench = spark.createDataFrame([("q", "A b", 1), (None, "b C", 2)], "item_id string, text string, said int")
    assert [(r["n_hit"], r["items"], r["spans"]) for r in D.contamination(docs, bench).collect()] == [(3, ["", "q"], "0:5")]
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.clean_documents(docs, bench).count() == 0 and D.clean_documents(docs, none).columns == docs.columns
    assert D.clean_documents(docs.unionByName(docs.selectExpr("2 as doc_id", "'a c b' as text", "runs", "items")), bench, most=1).count() == 1

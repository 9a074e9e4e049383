"""Quotient filters by round trips; collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import collocations as C
from spanloom.llm import quotient_filter as qf

U = np.uint64


@pytest.mark.parametrize("size, bits", [(2, 1), (2, 7), (2, 31), (3, 5), (4, 17), (5, 12), (5, 19), (5, 25)])
def test_filters_lose_nothing(size, bits):
    rng = np.random.default_rng(size * 100 + bits)
    grams = rng.integers(0, 1 << bits, (4000, size))
    grams[:2000] = grams[rng.integers(2000, 4000, 2000)]
    grams[:700] = grams[0]
    half = qf.half_bits(size, bits)
    left, right = qf.packed(list(grams.T), bits)
    assert (qf.unpacked(left, right, size, bits) == grams).all()
    pl, pr = qf.permuted(left, right, half)
    bl, br = qf.restored(pl, pr, half)
    assert (bl == left).all() and (br == right).all()
    assert len(set(zip(pl.tolist(), pr.tolist(), strict=True))) == len({tuple(g) for g in grams.tolist()})
    for shard_bits in {0, min(3, half), min(11, half)}:
        filters = defaultdict(list)
        for part in (slice(0, 1500), slice(1500, 1501), slice(1501, 4000)):
            sl, sr, n = qf.summed(pl[part], pr[part], None, half)
            shard = (sl >> U(half - shard_bits)).astype("i8")
            for s in np.unique(shard):
                here = shard == s
                filters[int(s)].append(qf.encoded(sl[here], sr[here], n[here], half, shard_bits))
        found = {}
        for s, data in filters.items():
            l, r, n = qf.merged([qf.decoded(d, half, s, shard_bits) for d in data], half)
            assert (np.lexsort((r, l)) == np.arange(len(l))).all()
            found |= dict(zip(map(tuple, qf.unpacked(*qf.restored(l, r, half), size, bits).tolist()), n.tolist(), strict=True))
        assert found == Counter(map(tuple, grams.tolist()))


def test_filters_are_compact():
    rng = np.random.default_rng(1)
    left, right = qf.permuted(*qf.packed(list(rng.integers(1, 1 << 17, (100_000, 4)).T), 17), 34)
    data = qf.encoded(*qf.summed(left, right, None, 34), 34, 0)
    assert len(data) < 11 * 100_000  # 68 bits of n-gram and a counter


def plain(docs, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for size in range(1, longest + 1):
                for i in range(len(ws) - size + 1):
                    f[lang or "und"][tuple(ws[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = lambda g, h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        rows = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= 100 * a and inside(g, h) for h, b in cand.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), l, r))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


def texts(seed, count=150):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "Ça", "d\x01", "e", "F1", "É", "g-h", "i'", "ж", "\x0cz", "rare%d"]
    phrase = ["new york city hall", "e e e e e e", "Ça va bien", "alpha beta ж e F1 g-h"]
    docs = []
    for i in range(count):
        parts = [rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(phrase) for _ in range(rng.randrange(40))]
        parts = [p.replace("%d", str(rng.randrange(1000))) for p in parts]
        docs.append(("".join(p + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ". ", "?!"]) for p in parts), rng.choice(["en", "en", "fr", None, "und"])))
    return docs


@pytest.mark.parametrize("most_words", [10**6, 0])
def test_equals_plain_counting(spark, most_words):
    docs = [*texts(1), (None, "en"), ("", None), (" . \t", "xx"), ("word " * 3000, "long")]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "text string, lang string, id int, word string").repartition(5)
    got = sorted(tuple(r) for r in C.collocations(df, least=4, top=40, most_words=most_words).collect())
    assert got == plain(docs, 4, 5, 40)
    assert len(got) > 50


def test_no_rows_and_no_phrases(spark):
    df = spark.createDataFrame([("a b. c d", "en")], "text string, lang string")
    assert C.collocations(df).count() == 0
    assert C.collocations(df.limit(0)).count() == 0
    assert sorted(r["phrase"] for r in C.collocations(df, least=1).collect()) == ["a b", "c d"]


def test_scores_beyond_64_bits(spark):
    grams = spark.createDataFrame([([1, 2], 10**12)], "ids array<int>, f long")
    words = spark.createDataFrame([(1, "en", "a", 10**12, 4 * 10**13), (2, "en", "b", 3 * 10**12, 4 * 10**13)], "id long, lang string, word string, c long, n long")
    assert [r["score"] for r in C.scored(grams, words).collect()] == [1000 * 10**12 * 4 * 10**13 // (3 * 10**24)]

"""Suffix stripping after Porter (1980) with the usual extensions, as native expressions: Column in, Column out.

A word's letters become c and v; its measure is the number of v...c turns. Each
step takes the first rule whose suffix the word has and applies it if the
condition on the rest holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words with stems of their own
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# fixed values: suffixes, what replaces them, and the measure that the rest must exceed (-1: any)
PLURALS = [("sses", "ss", -1), ("ies", "i", -1), ("ss", "ss", -1), ("s", "", -1)]
DOUBLE = [
    ("ational", "ate", 0), ("tional", "tion", 0), ("enci", "ence", 0), ("anci", "ance", 0), ("izer", "ize", 0), ("bli", "ble", 0), ("alli", "al", 0), ("entli", "ent", 0), ("eli", "e", 0), ("ousli", "ous", 0),
    ("ization", "ize", 0), ("ation", "ate", 0), ("ator", "ate", 0), ("alism", "al", 0), ("iveness", "ive", 0), ("fulness", "ful", 0), ("ousness", "ous", 0), ("aliti", "al", 0), ("iviti", "ive", 0), ("biliti", "ble", 0),
    ("fulli", "ful", 0),
]
FULL = [("icate", "ic", 0), ("ative", "", 0), ("alize", "al", 0), ("iciti", "ic", 0), ("ical", "ic", 0), ("ful", "", 0), ("ness", "", 0)]
LONG = [(s, "", 1) for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def shape(word: Column) -> Column:
    """c and v for each letter; y is a vowel after a consonant."""
    marked = F.regexp_replace(word, "([^aeiou])y", "$1Y")
    return F.regexp_replace(F.regexp_replace(marked, "[aeiouY]", "\u0001"), "[^\u0001]", "c")


def measure(word: Column) -> Column:
    return F.size(F.regexp_extract_all(shape(word), F.lit("\u0001+c+"), 0))


def _less(word: Column, n: int) -> Column:
    return F.substr(word, F.lit(1), F.greatest(F.length(word) - n, F.lit(0)))


def _short_end(word: Column) -> Column:
    """Consonant, vowel, consonant other than w, x, y at the end; or a word of a vowel and a consonant."""
    return (shape(word).rlike("c\u0001c$") & ~word.rlike("[wxy]$")) | (shape(word) == "\u0001c")


def _ruled(word: Column, rules: list[tuple[str, str, int]], extra: Callable[[str, Column], Column] | None = None) -> Column:
    out = None
    for suffix, put, least in rules:
        rest = _less(word, len(suffix))
        fine = F.lit(True) if least < 0 else measure(rest) > least
        if extra is not None and suffix == "ion":
            fine = fine & extra(suffix, rest)
        new = F.when(fine, F.concat(rest, F.lit(put))).otherwise(word)
        out = F.when(word.endswith(suffix), new) if out is None else out.when(word.endswith(suffix), new)
    return out.otherwise(word)


def _plural(word: Column) -> Column:
    return F.when(word.rlike("^.ies$"), _less(word, 1)).otherwise(_ruled(word, PLURALS))


def _past(word: Column) -> Column:
    def mended(stem: Column) -> Column:
        twice = stem.rlike(r"([^aeiou])\1$") & shape(stem).endswith("cc")
        return (
            F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(twice, F.when(stem.rlike("[lsz]$"), stem).otherwise(_less(stem, 1)))
            .when((measure(stem) == 1) & _short_end(stem), F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )

    vowel = lambda n: shape(_less(word, n)).contains("\u0001")
    return (
        F.when(word.rlike("^.ied$"), _less(word, 1))
        .when(word.endswith("ied"), _less(word, 2))
        .when(word.endswith("eed"), F.when(measure(_less(word, 3)) > 0, _less(word, 1)).otherwise(word))
        .when(word.endswith("ed") & vowel(2), let(_less(word, 2), mended))
        .when(word.endswith("ing") & vowel(3), let(_less(word, 3), mended))
        .otherwise(word)
    )


def _final_y(word: Column) -> Column:
    return F.when(word.endswith("y") & (F.length(word) > 2) & shape(_less(word, 1)).endswith("c"), F.concat(_less(word, 1), F.lit("i"))).otherwise(word)


def _double(word: Column) -> Column:
    ruled = lambda w: F.when(w.endswith("logi"), F.when(measure(_less(w, 3)) > 0, _less(w, 1)).otherwise(w)).otherwise(_ruled(w, DOUBLE))
    return let(F.when(word.endswith("alli") & (measure(_less(word, 4)) > 0), _less(word, 2)).otherwise(word), ruled)


def _last(word: Column) -> Column:
    e = _less(word, 1)
    bare = F.when(word.endswith("e") & ((measure(e) > 1) | ((measure(e) == 1) & ~_short_end(e))), e).otherwise(word)
    return let(bare, lambda w: F.when(w.endswith("ll") & (measure(_less(w, 1)) > 1), _less(w, 1)).otherwise(w))


STEPS = (_plural, _past, _final_y, _double, lambda w: _ruled(w, FULL), lambda w: _ruled(w, LONG, lambda _, rest: rest.rlike("[st]$")), _last)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters stay."""
    out = word
    for step in STEPS:
        out = let(out, step)
    odd = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.coalesce(F.try_element_at(odd, word), F.when(F.length(word) <= 2, word).otherwise(out))


def stem_key(name: Column) -> Column:
    """Names as keys of clusters: without parentheses and what follows a slash, lower case, stems of the words joined."""
    plain = F.lower(F.split_part(F.regexp_replace(name, r"\s*\([^)]*\)\s*", " "), F.lit("/"), F.lit(1)))
    plain = F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), "^[ .,;:-]+|[ .,;:-]+$", "")
    return F.array_join(F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), stem), "")

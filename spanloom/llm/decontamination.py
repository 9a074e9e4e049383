"""Benchmark decontamination with one Aho-Corasick automaton over words.

Benchmark texts are normalised to words; every run of ``WINDOW`` words of an
item is a pattern (a shorter item is one). The automaton reads the word numbers
of a text once and reports each place where a pattern ends. Words are matched by
their order in the text, so a hit maps to the original through the places of the
words there; spans count code points of the text as it was.

The automaton is broadcast as the items' words, at most ``PATTERNS`` patterns of
them. A larger benchmark is dealt to several automata by a hash of the item; a
text passes from one to the next within a task, with what was found so far, so
texts are never shuffled and no pattern is left out.

Defined results: null and empty texts have no words and no hits; null or empty
items have no pattern; items of one id are one item, a null id is written as an
empty string; texts of any length are read whole; repeated documents are each
reported; an empty table gives no rows, an empty benchmark no hits; other
columns are ignored (``clean_documents`` keeps them).
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, PATTERNS = 10, 200_000
#: A word as it stands in a text that isn't lower-cased yet.
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BUILT: dict[str, Automaton] = {}


def words(text: str) -> list[bytes]:
    """Normalised words: lower-case a-z, digits and whatever lies beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_words(text: Column) -> Column:
    """The same words as an array of strings."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)


class Automaton:
    """All windows of some items, (name, words) each."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.sizes: list[int] = []
        self.owners: list[set[str]] = []
        places: dict[tuple[int, ...], int] = {}
        for name, said in items:
            ids = [self.number.setdefault(w.encode(), len(self.number) + 1) for w in said]
            for at in range(max(1, len(ids) - window + 1)):
                pattern = tuple(ids[at : at + window])
                if pattern not in places:
                    places[pattern] = len(places)
                    self.sizes.append(len(pattern))
                    self.owners.append(set())
                self.owners[places[pattern]].add(name)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for pattern, k in places.items():
            self.machine.add_word(pattern, k)
        if places:
            self.machine.make_automaton()

    def matches(self, said: list[bytes], hit: np.ndarray | None, found: set[str]) -> np.ndarray | None:
        """Marks hit words (an array made at the first hit) and adds the names of the items found."""
        if not self.sizes:
            return hit
        seen = set()
        for last, k in self.machine.iter(tuple(map(self.number.get, said, repeat(0)))):
            if hit is None:
                hit = np.zeros(len(said), bool)
            hit[last + 1 - self.sizes[k] : last + 1] = True
            seen.add(k)
        for k in seen:
            found |= self.owners[k]
        return hit


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype("i1"))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) in code points of the text of each run of hit words."""
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in zip(*_runs(hit), strict=True)]


def _blocks(bench: DataFrame, window: int, most: int) -> list[list[tuple[str, list[str]]]]:
    """Items' words in blocks of about ``most`` patterns."""
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), item_words(F.col("text")).alias("said")).where(F.size("said") > 0)
    n = rows.agg(F.sum(F.greatest(F.size("said") - (window - 1), F.lit(1)))).first()[0] or 0
    parts = max(1, math.ceil(n / most))
    block = F.pmod(F.xxhash64("item", "said"), F.lit(parts))
    return [[(r["item"], list(r["said"])) for r in rows.where(block == k).orderBy("item", "said").collect()] for k in range(parts)]


STATE = "doc_id {id}, text string, runs array<int>, items array<string>"
REPORT = "doc_id {id}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, spans string, contaminated boolean"


def _scanner(items, window: int, last: bool):
    """A function over Arrow batches (doc_id, text, runs of hit words, items): the next state, or the report."""

    def scan(batches):
        import pyarrow as pa

        key, held = items.value
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Automaton(held, window)
        machine = _BUILT[key]
        for batch in batches:
            cols = {n: [] for n in ("runs", "items", "n_words", "n_hit", "spans")}
            for text, runs, names in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                said, found, hit = words(text or ""), set(names), None
                if runs:
                    hit = np.zeros(len(said), bool)
                    for a, b in zip(runs[::2], runs[1::2], strict=True):
                        hit[a:b] = True
                hit = machine.matches(said, hit, found)
                cols["items"].append(sorted(found))
                if last:
                    cols["n_words"].append(len(said))
                    cols["n_hit"].append(0 if hit is None else int(hit.sum()))
                    cols["spans"].append("" if hit is None else ",".join(f"{a}:{b}" for a, b in spans(text, hit)))
                else:
                    cols["runs"].append([] if hit is None else np.stack(_runs(hit), 1).ravel().tolist())
            if not last:
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cols["runs"], pa.list_(pa.int32())), pa.array(cols["items"], pa.list_(pa.string()))], names=["doc_id", "text", "runs", "items"])
                continue
            digests = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in cols["items"]]
            yield pa.record_batch(
                [batch.column(0), pa.array(cols["n_words"], pa.int64()), pa.array(cols["n_hit"], pa.int64()), pa.array([len(i) for i in cols["items"]], pa.int64()), pa.array(cols["items"], pa.list_(pa.string())),
                 pa.array(digests, pa.string()), pa.array(cols["spans"], pa.string()), pa.array([h > 0 for h in cols["n_hit"]], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "spans", "contaminated"],
            )

    return scan


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, most: int = PATTERNS) -> DataFrame:
    """Per document (doc_id, text): n_words, n_hit, n_items, items, items_sha256, spans (start:end of hit stretches), contaminated.

    ``bench``: (item_id, text).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = _blocks(bench, window, most)
    state = docs.select("doc_id", F.col("text").cast("string"), F.expr("cast(array() as array<int>)").alias("runs"), F.expr("cast(array() as array<string>)").alias("items"))
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        held = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(repr((block, window)).encode()).hexdigest(), block))
        state = state.mapInArrow(_scanner(held, window, last), (REPORT if last else STATE).format(id=kind))
    return state


def clean_documents(docs: DataFrame, bench: DataFrame, window: int = WINDOW, most: int = PATTERNS) -> DataFrame:
    """Rows and columns of ``docs`` whose text holds no window of the benchmark."""
    blocks = _blocks(bench, window, most)
    kept = docs
    for block in blocks:
        held = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(repr((block, window)).encode()).hexdigest(), block))

        @F.pandas_udf("boolean")
        def clean(texts, held=held):
            key, items = held.value
            if key not in _BUILT:
                _BUILT.clear()
                _BUILT[key] = Automaton(items, window)
            return texts.map(lambda t: _BUILT[key].matches(words(t or ""), None, set()) is None)

        kept = kept.where(clean(F.col("text").cast("string")))
    return kept

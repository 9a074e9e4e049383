"""Token counts that follow edits without counting whole texts again.

A document keeps a segment tree: its leaves are stretches of whole pre-tokens
(about ``LEAF`` characters, cut before a blank between two words, where the
pre-tokenizer always cuts), with their characters and tokens; inner nodes hold
the sums. An edit walks down the character sums to the leaves it touches. If it
changed the characters around a cut, the leaf next to it joins in as context.
Only these leaves are encoded again, and the sums above them are updated.

Defined results: null text counts as empty (0 tokens, no leaves); edits are
(start, end, text) in code points of the text before any of them, must not
overlap, and are clipped to the text; null edits are none; repeated rows are
counted one by one; an empty table gives no rows; other columns are kept, in
``with_trees`` and ``edited`` alike, but for those named like a column that is
added, which the added one replaces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnitEncoder, tokenizer_path

LEAF = 256
EDITS = "array<struct<start: int, end: int, text: string>>"
SPACES = frozenset(chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def cut_ok(left: str, right: str) -> bool:
    """Whether two neighbouring stretches have the tokens of their union: a word's end, then a blank and a word."""
    return len(left) > 0 and len(right) > 1 and left[-1] not in SPACES and right[0] == " " and right[1] not in SPACES


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    out, begin, n = [], 0, len(text)
    while n - begin > size:
        at = text.find(" ", begin + size)
        while at >= 0 and (at + 1 >= n or text[at - 1] in SPACES or text[at + 1] in SPACES):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[begin:at])
        begin = at
    if begin < n:
        out.append(text[begin:])
    return out


class SegmentTree:
    """Sums of characters and tokens over leaves, in one array with the root at 1."""

    def __init__(self, chars, tokens):
        n = len(chars)
        self.width = 1 << max(0, n - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), "i8")
        self.sums[self.width : self.width + n, 0] = chars
        self.sums[self.width : self.width + n, 1] = tokens
        level = self.width
        while level > 1:
            half = level >> 1
            self.sums[half:level] = self.sums[level : 2 * level].reshape(half, 2, 2).sum(axis=1)
            level = half

    def leaf_at(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) of a character's place; the last leaf with any for places beyond."""
        char = min(char, max(0, int(self.sums[1, 0]) - 1))
        node, first = 1, 0
        while node < self.width:
            node *= 2
            if char - first >= self.sums[node, 0]:
                first += int(self.sums[node, 0])
                node += 1
        return node - self.width, first

    def update(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node >>= 1

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])


def apply_edits(tree: SegmentTree, leaves: list[str], edits: list[tuple[int, int, str]]) -> set[int]:
    """Changes ``leaves`` (a joined leaf becomes empty) and returns which must be encoded again."""
    dirty: set[int] = set()
    n = sum(map(len, leaves))
    for start, end, text in sorted(edits, reverse=True):  # from the back, so places before stay true
        start, end = max(0, min(start, n)), max(0, min(max(start, end), n))
        if not leaves:
            leaves.append("")
        first, at = tree.leaf_at(start)
        whole, last = leaves[first], first
        # the tree has the lengths before the edits; leaves behind this one have changed already, this one not
        while end - at > len(whole):
            last += 1
            whole += leaves[last]
            leaves[last] = ""
            dirty.discard(last)
        leaves[first] = whole[: start - at] + text + whole[end - at :]
        dirty.add(first)
    for i in sorted(dirty):
        while leaves[i]:
            left = next((k for k in range(i - 1, -1, -1) if leaves[k]), None)
            if left is not None and not cut_ok(leaves[left], leaves[i]):
                leaves[left] += leaves[i]
                leaves[i] = ""
                dirty.add(left)
                i = left
                continue
            right = next((k for k in range(i + 1, len(leaves)) if leaves[k]), None)
            if right is None or cut_ok(leaves[i], leaves[right]):
                break
            leaves[i] += leaves[right]
            leaves[right] = ""
    return dirty


def with_trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``docs`` with leaf_chars and leaf_tokens, the leaves of each text's tree."""
    path = tokenizer or tokenizer_path()
    docs = docs.drop("leaf_chars", "leaf_tokens")
    column = docs.columns.index("text")

    def build(batches):
        import pyarrow as pa

        encoder = UnitEncoder.load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                cut = [leaves_of(t or "") for t in part.column(column).to_pylist()]
                flat = [x for c in cut for x in c]
                tokens = np.diff(encoder.encode(pa.array(flat, pa.string()))[1])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in cut])]), pa.int32())
                added = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (np.array([len(x) for x in flat], "i4"), tokens.astype("i4"))]
                yield pa.record_batch([*part.columns, *added], names=[*part.schema.names, "leaf_chars", "leaf_tokens"])

    schema = docs.select("*", F.lit(None).cast("array<int>").alias("leaf_chars"), F.lit(None).cast("array<int>").alias("leaf_tokens")).schema
    return docs.mapInArrow(build, schema)


def edited(trees: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Rows of ``with_trees`` with a column ``edits`` (see EDITS): text and tree after the edits, and
    n_tokens before, n_edits, n_tokens_after, reencoded_chars."""
    path = tokenizer or tokenizer_path()
    trees = trees.drop("n_tokens", "n_edits", "n_tokens_after", "reencoded_chars")
    names = trees.columns

    def work(batches):
        import pyarrow as pa

        encoder = UnitEncoder.load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                columns = {c: part.column(names.index(c)).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits")}
                rows, todo = [], []
                for text, chars, tokens, edits in zip(*columns.values(), strict=True):
                    tree = SegmentTree(chars, tokens)
                    ends = np.cumsum(chars, dtype="i8").tolist()
                    leaves = [(text or "")[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
                    before, list_ = tree.tokens, [(e["start"], e["end"], e["text"] or "") for e in edits or []]
                    dirty = apply_edits(tree, leaves, list_) if list_ else set()
                    rows.append((tree, leaves, before, len(list_), text))
                    todo += [(len(rows) - 1, i, leaves[i]) for i in dirty if leaves[i]]
                counts = np.diff(encoder.encode(pa.array([t for *_, t in todo], pa.string()))[1])
                new, again = {(r, i): int(c) for (r, i, _), c in zip(todo, counts, strict=True)}, [0] * len(rows)
                for r, _, t in todo:
                    again[r] += len(t)
                out: dict[str, list] = {c: [] for c in ("text", "leaf_chars", "leaf_tokens", "n_tokens", "n_edits", "n_tokens_after", "reencoded_chars")}
                for r, (tree, leaves, before, n, text) in enumerate(rows):
                    if n:
                        for i, t in enumerate(leaves):
                            if i < tree.width:
                                old = tree.sums[tree.width + i]
                                if (r, i) in new or not t and old[0]:
                                    tree.update(i, len(t), new.get((r, i), 0))
                    held = tree.sums[tree.width : tree.width + len(leaves)]
                    full = held[:, 0] > 0
                    values = ("".join(leaves) if n else text, held[full, 0].tolist(), held[full, 1].tolist(), before, n, tree.tokens, again[r])
                    for c, v in zip(out, values, strict=True):
                        out[c].append(v)
                made = {"text": pa.array(out["text"], pa.string()), "leaf_chars": pa.array(out["leaf_chars"], pa.list_(pa.int32())), "leaf_tokens": pa.array(out["leaf_tokens"], pa.list_(pa.int32()))}
                kept = [made.get(c, part.column(k)) for k, c in enumerate(names)]
                yield pa.record_batch([*kept, *[pa.array(out[c], pa.int64()) for c in list(out)[3:]]], names=[*names, *list(out)[3:]])

    added = [F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_edits", "n_tokens_after", "reencoded_chars")]
    return trees.mapInArrow(work, trees.select("*", *added).schema)


def sample_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with edits that reach every text: a header, a changed middle and a cut end, where there is room."""
    n = F.length(F.coalesce("text", F.lit("")))
    middle = F.floor(n / 2).cast("int")
    edits = [
        (F.lit(True), F.lit(0), F.lit(0), F.concat(F.lit("["), F.coalesce(F.col("lang").cast("string"), F.lit("?")) if "lang" in docs.columns else F.lit("?"), F.lit("] "))),
        (n >= 40, middle, middle + 9, F.lit(" edited, text")),
        (n >= 80, n - 21, n, F.lit("")),
    ]
    made = F.array(*[F.when(cond, F.struct(F.lit(a).alias("start") if isinstance(a, int) else a.cast("int").alias("start"), b.cast("int").alias("end"), t.alias("text"))) for cond, a, b, t in edits])
    return docs.withColumn("edits", F.array_compact(made).cast(EDITS))


def edit_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, n_edits, n_tokens_after, n_leaves, reencoded_chars, under ``sample_edits``."""
    trees = with_trees(docs.select("doc_id", "text", *["lang"] * ("lang" in docs.columns)), tokenizer)
    return edited(sample_edits(trees), tokenizer).select("doc_id", "n_tokens", "n_edits", "n_tokens_after", F.size("leaf_chars").alias("n_leaves"), "reencoded_chars")

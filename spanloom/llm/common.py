"""What the operators share: shared-folder tables, words, text clean-up and tokenizing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from array import array

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``; where that is unset a new folder is made and
    set, but only in local mode, where driver and executors are one process.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts lineage, survives lost executors and gives Spark true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def released(f):
    """``f`` over Arrow batches; at its end the worker gives memory that it no longer uses back to the system.

    Workers stay for the next stages and share an executor's memory with the JVM.
    """

    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


# --- tokenizing -----------------------------------------------------------------

#: Python workers live on between tasks; so do their tokenizers and word caches.
_LOADED: dict[str, UnitEncoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Classes of characters for the pre-tokenizer; ODD ones send their text to the library whole.
LETTER, DIGIT, OTHER, BLANK, WHITE, ODD = range(6)
_CLASSES: list = []


def _classes():
    """Class of each code point below 2**17, and of all beyond as the last entry.

    Letters and numbers are those that an old and the current edition of Unicode
    agree on; where they differ, and for white space beyond ASCII, the library decides.
    """
    import unicodedata

    import numpy as np

    if not _CLASSES:
        table = np.full((1 << 17) + 1, ODD, "u1")
        old = unicodedata.ucd_3_2_0.category
        for code in range(1 << 17):
            char = chr(code)
            now, then = unicodedata.category(char), old(char)
            kind = {"L": LETTER, "N": DIGIT}.get(now[0], OTHER)
            if now != "Cn" and then != "Cn" and now != "Cs" and kind == {"L": LETTER, "N": DIGIT}.get(then[0], OTHER):
                table[code] = kind
            if char.isspace():
                table[code] = ODD
        table[ord(" ")] = BLANK
        table[[9, 10, 11, 12, 13]] = WHITE
        _CLASSES.append(table)
    return _CLASSES[0]


class UnitEncoder:
    """Byte-level BPE ids of whole texts, pre-token by pre-token, with a bounded cache.

    Pre-tokens (a contraction; letters, digits or other signs with one blank
    before them; white space) are found for all texts of a chunk with numpy,
    Arrow finds the distinct ones, each is looked up or encoded once by the
    library, and the ids are gathered. Texts that hold the string of an added
    token or a character of class ODD are encoded whole, so the ids are always
    those of the library for the whole text.
    """

    LIMIT = 700_000
    CHUNK = 4_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> UnitEncoder:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, units: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens, through the cache."""
        cache = self.parts
        new = [u for u in units if u not in cache]
        if new:
            if len(cache) + len(new) > self.LIMIT:  # what this chunk uses stays
                cache = self.parts = {u: cache[u] for u in units if u in cache}
            for lo in range(0, len(new), 10_000):
                few = new[lo : lo + 10_000]
                cache.update(zip(few, self.whole(few), strict=True))
        return [cache[u] for u in units]

    def encode(self, texts):
        """(ids uint32, starts int64): the ids of all texts of an Arrow string array, one after
        another, and where each begins, with the end of the last."""
        import numpy as np

        ids, ends, lo, n = [], [np.zeros(1, "i8")], 0, len(texts)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False) if n else []
        at = np.cumsum(sizes)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, (at[lo - 1] if lo else 0) + self.CHUNK, "right")))
            got, cum = self._chunk(texts.slice(lo, hi - lo).cast(pa.large_string()))
            ids.append(got)
            ends.append(ends[-1][-1] + cum)
            lo = hi
        return (np.concatenate(ids) if ids else np.zeros(0, "<u4")), np.concatenate(ends)

    @staticmethod
    def _marked(data, offsets):
        """(class of each byte, whether a text begins there); the bytes of a character share its class."""
        import numpy as np

        table = _classes()
        kinds = table[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            more = np.concatenate([data, np.zeros(3, "u1")])
            b0, b1, b2, b3 = (more[lead + k].astype("u4") for k in range(4))
            three, four = b0 >= 0xE0, b0 >= 0xF0
            code = np.where(four, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | (b3 & 63), np.where(three, (b0 & 15) << 12 | (b1 & 63) << 6 | (b2 & 63), (b0 & 31) << 6 | (b1 & 63)))
            kind = table[np.minimum(code, 1 << 17)]
            kinds[lead] = kinds[lead + 1] = kind
            kinds[lead[three] + 2] = kind[three]
            kinds[lead[four] + 3] = kind[four]
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        return kinds, begins

    @staticmethod
    def _starts(data, kinds, begins):
        """Places where pre-tokens begin."""
        import numpy as np

        first, n = begins[:-1], len(data)
        white = kinds >= BLANK
        before = np.empty_like(kinds)
        before[0], before[1:] = OTHER, kinds[:-1]
        after_white = before >= BLANK
        starts = first | (~white & (before != kinds) & (before != BLANK)) | (white & ~after_white)
        # the last of several white characters before a word stands apart from the others
        last = white & after_white & ~first
        last[:-1] &= ~white[1:] & ~first[1:]
        last[-1] = False
        starts |= last
        quotes = np.flatnonzero((data == ord("'")) & starts)
        if len(quotes):
            more = np.concatenate([data, np.zeros(2, "u1")])
            ends = np.concatenate([begins, [True]])
            a, b = more[quotes + 1], more[quotes + 2]
            one = ~ends[quotes + 1] & np.isin(a, np.frombuffer(b"stmd", "u1"))
            pair = a.astype("u2") << 8 | b
            two = ~one & ~ends[quotes + 1] & ~ends[quotes + 2] & np.isin(pair, [a << 8 | b for a, b in (b"re", b"ve", b"ll")])
            starts[quotes[one | two] + 1] = False
            stops = np.concatenate([quotes[one] + 2, quotes[two] + 3])
            starts[stops[stops < n]] = True
        return np.flatnonzero(starts)

    def _chunk(self, texts):
        import numpy as np

        offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
        if offsets[0] == offsets[-1]:
            return np.zeros(0, "<u4"), np.zeros(len(texts), "i8")
        data = np.frombuffer(texts.buffers()[2], "u1")[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kinds, begins = self._marked(data, offsets)
        plain = np.ones(len(texts), bool)
        plain[np.searchsorted(offsets, np.flatnonzero(kinds == ODD), "right") - 1] = False
        for word in self.added:
            plain &= ~pc.match_substring(texts, word).to_numpy(zero_copy_only=False)
        if not plain.all():
            return self._mixed(texts, plain)
        starts = self._starts(data, kinds, begins)
        places = np.append(starts, len(data)).astype("i8")
        units = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        values = self._known(units.dictionary.to_pylist())
        codes = units.indices.to_numpy()
        lens = np.fromiter(map(len, values), "i4", len(values)) >> 2
        at = np.cumsum(lens, dtype="i8") - lens
        pool = np.frombuffer(b"".join(values), "<u4")
        n = lens[codes]
        cum = np.zeros(len(n) + 1, "i8")
        np.cumsum(n, out=cum[1:])
        where = np.arange(int(cum[-1]), dtype="i4")
        where += np.repeat((at[codes] - cum[:-1]).astype("i4"), n)
        return pool[where], cum[np.searchsorted(starts, offsets[1:])]

    def _mixed(self, texts, plain):
        import numpy as np

        out = [b""] * len(plain)
        odd = np.flatnonzero(~plain)
        for i, b in zip(odd.tolist(), self.whole(texts.take(pa.array(odd)).to_pylist()), strict=True):
            out[i] = b
        rest = np.flatnonzero(plain)
        if len(rest):
            ids, ends = self._chunk(texts.take(pa.array(rest)))
            for i, lo, hi in zip(rest.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[i] = ids[lo:hi].tobytes()
        return np.frombuffer(b"".join(out), "<u4"), np.cumsum([len(b) >> 2 for b in out], dtype="i8")

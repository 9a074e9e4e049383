"""Secret scans with a recursive decoding worklist.

Three kinds of base matches are found in each whole text. Then encoded layers
are unwrapped: percent escapes and Unicode escapes are decoded in place, base64
runs into layers of their own, compressed data inside them as well. Each new
layer is scanned with the same patterns and put on the worklist, until none
gives anything new. A layer whose content was seen before at the same place of
the text is not opened again, which ends cycles; at another place it is, so all
copies of an encoded secret have spans. Matches in a layer are mapped to the span
of the original text that they were decoded from.

A base64 run is decoded from each of its first four characters, since letters
before it shift it; a short last line after long ones is tried as part of a
wrapped run and as a word of its own. Lines of one length are tried as one run
whatever that length, with what stands before them at a line's end and with the
shorter line after them. Runs of fewer than 16 characters can't hold a secret.
Compressed data (gzip, zlib, bzip2, xz) is looked for at every place of decoded
and unpacked bytes and read member by member as far as it goes, cut or damaged
data up to the damage. Within one run each unpacked content is opened once,
however many ways lead to it, as all of them map to the same span. Layers that
aren't clean UTF-8 or UTF-16 are unwrapped like others.

Bounds are never silent: where a text's compressed data unpacks to more than
``BUDGET`` bytes in all, or one stream to more than ``WHOLE``, the run has a span
of the kind ``unread`` as well, so redaction removes it whole. Streams beyond
``WHOLE`` are scanned in windows that overlap.

Defined results: null text counts as empty (no spans); texts of any length are
scanned whole; repeated rows are scanned one by one; an empty table gives no
rows; other columns are ignored (``redacted_documents`` keeps them).
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released

KINDS = ("assign", "access", "hex", "unread")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+")
ONE_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{40,}\r?\n)*(?:[A-Za-z0-9+/_-]{16,}={0,2}|(?<=\n)(?:[A-Za-z0-9+/_-]{1,15}={0,2}|={1,2}))")
SHORT_LAST = re.compile(r"\r?\n[A-Za-z0-9+/_-]{0,15}={0,2}\Z")
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
#: Lines that may be part of base64 wrapped at fewer than 40 columns, the end of a line before them and the start of one after.
SHORT_LINE = re.compile(r"^([A-Za-z0-9+/_-]{1,39})(={0,2})\r?$", re.MULTILINE)
LINE_END = re.compile(r"[A-Za-z0-9+/_-]{1,512}\r?\n\Z")
LINE_START = re.compile(r"([A-Za-z0-9+/_-]{1,39})={0,2}(?![A-Za-z0-9+/_=-])")
WINDOW, OVERLAP, WHOLE, BUDGET = 16_000_000, 1_000_000, 64_000_000, 1 << 30
URL_SAFE = str.maketrans("-_", "+/", "\r\n")


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of all base matches, in order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(found)


class Layer:
    """A decoded text and, for runs of its characters, where they came from in the layer above.

    Run k begins at ``new[k]``. A copied run has step 1: character new[k] + i
    came from old[k] + i. Any other run came as a whole from old[k]:end[k].
    """

    def __init__(self, text: str, above: Layer | None, new: list[int], old: list[int], end: list[int | None]):
        self.text, self.above, self.new, self.old, self.end = text, above, new, old, end

    def origin(self, start: int, stop: int) -> tuple[int, int]:
        layer = self
        while layer.above is not None:
            i, j = bisect_right(layer.new, start) - 1, bisect_right(layer.new, stop - 1) - 1
            begin = layer.old[i] + (start - layer.new[i] if layer.end[i] is None else 0)
            last = layer.old[j] + stop - layer.new[j] if layer.end[j] is None else layer.end[j]
            start, stop, layer = begin, last, layer.above
        return start, stop


def _percent(run: str) -> list[tuple[str, int]]:
    """(character, length it had) of a run of percent escapes; byte by byte if it isn't UTF-8."""
    data = bytes.fromhex(run.replace("%", ""))
    try:
        return [(c, 3 * len(c.encode())) for c in data.decode()]
    except UnicodeDecodeError:
        return [(c, 3) for c in data.decode("latin-1")]


def _unicode(run: str) -> list[tuple[str, int]]:
    out, units = [], [(int(next(g for g in m.groups() if g), 16), m.end() - m.start()) for m in ONE_UNICODE.finditer(run)]
    k = 0
    while k < len(units):
        code, size = units[k]
        if 0xD800 <= code < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
            code, size, k = 0x10000 + ((code - 0xD800) << 10) + units[k + 1][0] - 0xDC00, size + units[k + 1][1], k + 1
        out.append((chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�", size))
        k += 1
    return out


def _in_place(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with all runs of an escape decoded; None if there are none."""
    parts, new, old, end, at, done = [], [], [], [], 0, 0
    for m in pattern.finditer(layer.text):
        chars = decode(m.group())
        if m.start() > done:
            new.append(at)
            old.append(done)
            end.append(None)
            parts.append(layer.text[done : m.start()])
            at += m.start() - done
        place = m.start()
        for c, size in chars:
            new.append(at)
            old.append(place)
            end.append(place + size)
            parts.append(c)
            at, place = at + 1, place + size
        done = m.end()
    if not done:
        return None
    new.append(at)
    old.append(done)
    end.append(None)
    parts.append(layer.text[done:])
    return Layer("".join(parts), layer, new, old, end)


def _unpacker(head: bytes):
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78":
        return zlib.decompressobj()
    return bz2.BZ2Decompressor() if head[:3] == b"BZh" else lzma.LZMADecompressor()


class Unpacking:
    """What may still be unpacked for a text, and whether the run at hand was cut short."""

    def __init__(self):
        self.left, self.cut = BUDGET, False

    def stream(self, data: memoryview):
        """What compressed data unpacks to, in pieces of bounded size: all members, each as far as it can be read."""
        while MAGIC.match(data):
            tool, at = _unpacker(bytes(data[:3])), 0
            try:
                while at < len(data) and not tool.eof:
                    more, at = data[at : at + 65_536], at + 65_536
                    while more or not getattr(tool, "needs_input", True):
                        if (out := tool.decompress(more, 1 << 20)):
                            self.left -= len(out)
                            if self.left < 0:
                                self.cut = True
                                return
                            yield out
                        more = getattr(tool, "unconsumed_tail", b"")
                        if tool.eof:
                            break
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            if not tool.eof:
                return
            data = data[min(at, len(data)) - len(tool.unused_data) :]

    def contents(self, data: memoryview):
        """The output of a stream: whole up to WHOLE bytes, in overlapping windows beyond."""
        held, limit = bytearray(), WHOLE
        for piece in self.stream(data):
            held += piece
            if len(held) >= limit:
                limit, self.cut = WINDOW, True
                yield bytes(held)
                del held[:-OVERLAP]
        if held:
            yield bytes(held)

    def opened(self, data: bytes):
        """All that is compressed at any place of ``data``, and in that in turn, each content once."""
        work, seen = [data], set()
        while work:
            now = memoryview(work.pop())
            for m in MAGIC.finditer(now):
                for content in self.contents(now[m.start() :]):
                    digest = hashlib.sha256(content).digest()
                    if digest not in seen:
                        seen.add(digest)
                        yield content
                        if MAGIC.search(content):
                            work.append(content)


def _texts(data: bytes) -> list[str]:
    """Decoded bytes as text: UTF-16 where every other byte is NUL or a mark begins it, else UTF-8 as far as it is; NULs in and out."""
    half = len(data) // 2
    for code, mark, zeros in (("utf-16-le", b"\xff\xfe", data[1::2]), ("utf-16-be", b"\xfe\xff", data[::2])):
        if half and (data[:2] == mark or 2 * zeros.count(0) > half):
            try:
                return [data.decode(code)]
            except UnicodeDecodeError:
                break
    text = data.decode(errors="replace")
    return [text, text.replace("\0", "")] if "\0" in text else [text]


def _wrapped(text: str):
    """(start, end) of runs of lines of one length below 40 columns, with and without the line's end before them and the next line's start."""
    lines = [(m.start(), m.end(2), m.end() + 1, len(m.group(1)), bool(m.group(2))) for m in SHORT_LINE.finditer(text)] if "\n" in text else []
    k = 0
    while k < len(lines):
        begin, _, _, width, _ = lines[k]
        while k + 1 < len(lines) and lines[k + 1][0] == lines[k][2] and lines[k + 1][3] == width and not lines[k][4]:
            k += 1
        _, end, following, _, padded = lines[k]
        starts, ends = {begin}, {end}
        if not padded and (after := LINE_START.match(text, following)) and len(after.group(1)) <= width:
            ends.add(after.end())
        if before := LINE_END.search(text, max(0, begin - 600), begin):
            starts.add(before.start())
        if width >= 4:
            yield from ((a, b) for a in starts for b in ends if "\n" in text[a:b])
        k += 1


def _from_base64(layer: Layer, unpacking: Unpacking):
    """(layers of base64 runs and of what is compressed in them, runs that weren't read to the end)."""
    runs = []
    for m in BASE64.finditer(layer.text):
        runs.append((m.start(), m.end()))
        if short := SHORT_LAST.search(m.group()):
            runs.append((m.start(), m.start() + short.start()))
    runs += _wrapped(layer.text)
    out, cut = [], []
    for start, stop in sorted(set(runs)):
        body = layer.text[start:stop].translate(URL_SAFE).rstrip("=")
        unpacking.cut = False
        for skip in {0, 1, 2, 3, body.rfind("/") + 1}:
            part = body[skip:]
            if len(part) < 16:
                continue
            part = part[: len(part) - (len(part) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            for plain in (data, *unpacking.opened(data)) if MAGIC.search(data) else (data,):
                out += [Layer(text, layer, [0], [start], [stop]) for text in _texts(plain) if text]
        if unpacking.cut:
            cut.append((start, stop))
    return out, cut


def all_matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base matches, all matches mapped to the text), each sorted (start, kind index, end)."""
    base = base_matches(text)
    found, unpacking = set(base), Unpacking()
    work, seen, scanned = [Layer(text, None, [], [], [])], {(text, 0, len(text))}, {text: base}
    while work:
        layer = work.pop()
        opened, cut = _from_base64(layer, unpacking)
        found |= {(a, 3, b) for a, b in (layer.origin(*span) for span in cut)}
        if "%" in layer.text and (x := _in_place(layer, PERCENT, _percent)):
            opened.append(x)
        if "\\" in layer.text and (x := _in_place(layer, UNICODE, _unicode)):
            opened.append(x)
        for new in opened:
            place = new.text, *new.origin(0, len(new.text))
            if place not in seen:
                seen.add(place)
                work.append(new)
                if new.text not in scanned:
                    scanned[new.text] = base_matches(new.text)
                for start, kind, stop in scanned[new.text]:
                    a, b = new.origin(start, stop)
                    found.add((a, kind, b))
    return base, sorted(found)


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document: base counts, a digest of the base spans, and all spans (kind:start:end)."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [all_matches(t or "") for t in batch.column(1).to_pylist()]
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in rows] for kind in range(3)]
            digests = [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in rows]
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array([_written(s) for _, s in rows], pa.string())], names=REPORT.replace(",", "").split()[::2])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(scan), REPORT)


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every stretch that spans cover replaced by ``mark``."""
    out, done = [], 0
    for a, _, b in all_matches(text)[1]:
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redacted_documents(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All rows and columns of ``docs`` with secrets replaced in ``text``; ``n_chars``, if there, follows. Null stays null."""

    @F.pandas_udf(T.StringType())
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, mark))

    fixed = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        fixed = fixed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return fixed.select(*docs.columns)

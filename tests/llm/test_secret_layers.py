"""Layers in one another: time, unclean layers, wrapped lines, bounds that show."""

import base64
import gzip
import textwrap
import time
import zlib

import pytest

from spanloom.llm import secrets

SECRET = b"password = hunter2hunter2"


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


@pytest.mark.parametrize("level", [0, 9])
@pytest.mark.parametrize("depth", [1, 32, 60])
def test_many_compressed_layers_end_soon(level, depth):
    data = SECRET
    for _ in range(depth):
        data = gzip.compress(data, level)
    began = time.time()
    assert secrets.redact(f"see {b64(data)} now") == "see [secret] now"
    assert time.time() - began < 1.0


@pytest.mark.parametrize(
    "layer",
    [b"\xe9\xe9 key " + b64(SECRET).encode(), b"\x00\x01 key " + b64(SECRET).encode(), b"\xe9\xe9 password%3Dhunter2hunter2", b"\xe9\xe9 \\u0070assword = hunter2hunter2", b"\xff" + b64(b"\xff" + b64(b"\xff " + SECRET).encode()).encode()],
)
def test_unclean_layers_are_unwrapped(layer):
    text = f"see {b64(layer)} now"
    assert secrets.redact(text) == "see [secret] now"


@pytest.mark.parametrize("columns", [4, 12, 20, 32, 39, 64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_at_any_width(columns, end):
    body = b64(b"some words first, " + SECRET + b", and words after it")
    lines = end.join(textwrap.wrap(body, columns))
    for text, want in ((f"see:{end}{lines}{end}now, then", {f"see:{end}[secret]{end}now, then", f"see:{end}[secret], then"}), (f"see: {lines} now", None)):
        got = secrets.redact(text)
        assert got in want if want else ("[secret]" in got and body[-6:] not in got or columns >= len(body))
    # a line by itself holds no whole secret at these widths
    assert columns > 20 or not secrets.base_matches(base64.b64decode(body[:columns] + "===").decode(errors="replace"))


def test_the_short_last_line_goes_as_well():
    body = b64(b"x" * 30 + SECRET)
    lines = textwrap.wrap(body, 32)
    assert len(lines[-1]) < 32
    text = "\n".join(["see", *lines, "now it is", "done"])
    assert lines[-1] not in secrets.redact(text)


def test_bounds_leave_a_mark(monkeypatch):
    bomb = b64(zlib.compress(b"\0" * 3_000_000, 9))
    assert secrets.all_matches(f"see {bomb} now")[1] == []
    monkeypatch.setattr(secrets, "BUDGET", 1_000_000)
    text = f"see {bomb} now"
    assert secrets.all_matches(text) == ([], [(4, 3, 4 + len(bomb))])
    assert secrets.redact(text) == "see [secret] now"
    monkeypatch.setattr(secrets, "BUDGET", 1 << 30)
    for name, size in (("WHOLE", 200_000), ("WINDOW", 100_000), ("OVERLAP", 10_000)):
        monkeypatch.setattr(secrets, name, size)
    long = b64(zlib.compress(b"word " * 199_000 + SECRET + b" word" * 50_000))
    spans = secrets.all_matches(f"see {long} now")[1]
    assert {k for _, k, _ in spans} == {0, 3} and {(a, b) for a, _, b in spans} == {(4, 4 + len(long))}


def test_compressed_data_beyond_a_window_is_read_whole():
    import random

    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(300_000))
    inner = gzip.compress(noise + b" " + SECRET)
    text = b64(gzip.compress(b"\x80" * 10 + inner))
    assert secrets.redact(f"see {text} now") == "see [secret] now"

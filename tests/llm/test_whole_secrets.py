import base64
import bz2
import gzip
import hashlib
import random
import sys
import time
import types
import zlib

import pytest

from tidelog.llm import secretscan


@pytest.mark.parametrize("text", ["api_key = abc%2Bdefghijk", '{"token": "abc%2Bdefghijk"}', "api%5Fkey: abcdefghijkl", "api_key=abc%2Bdefghijk"])
def test_percent_between_blanks_and_quotes(text):
    text = f"first line\n{text}\nlast %41 line"
    spans = secretscan.find(text).spans
    assert [s[0] for s in spans] == ["assign"]
    found = text[spans[0][1] : spans[0][2]]
    assert found.startswith(("api", "token")) and found.endswith(("ijk", "jkl"))


SECRET = 'password: "hunter2hunter2"'


def wrap(data, width=76):
    run = base64.b64encode(data).decode()
    return "\n".join(run[k : k + width] for k in range(0, len(run), width))


def noise(n):
    return " ".join(hashlib.sha256(str(k).encode()).hexdigest()[:9].upper() for k in range(n)).encode()


@pytest.mark.parametrize("before, after", [("", ""), ("See below:\n", "\nRegards"), ("data: ", "\n\nend of it")])
def test_wrapped_base64(before, after):
    zipped = gzip.compress(noise(60) + b"\n" + SECRET.encode(), mtime=0)
    for data in (zipped, b"x" * 45 + b" " + SECRET.encode() + b" " + b"y" * 90):
        block = wrap(data)
        text = before + block + after
        spans = secretscan.find(text).spans
        assert ("assign", len(before), len(before) + len(block)) in spans


def test_many_layers_and_members_of_compression():
    deep = SECRET.encode()
    for _ in range(12):
        deep = gzip.compress(deep, mtime=0)
    two = lambda pack: pack(b"first part\n") + pack(SECRET.encode())
    for data in (deep, two(lambda x: gzip.compress(x, mtime=0)), two(bz2.compress), two(zlib.compress)):
        text = base64.b64encode(data).decode()
        assert ("assign", 0, len(text)) in secretscan.find(text).spans


def test_no_stream_is_cut():
    data = b"lorem ipsum dolor " * 2_500_000 + SECRET.encode()  # 45 MB
    text = "see " + base64.b64encode(gzip.compress(data, mtime=0)).decode()
    assert secretscan.find(text).spans == [("assign", 4, len(text))]


def test_pieces_overlap(monkeypatch):
    monkeypatch.setattr(secretscan, "PIECE", 500)
    monkeypatch.setattr(secretscan, "OVERLAP", 100)
    for before in range(480, 520):
        inner = b"," * before + SECRET.encode() + b"," * 700 + base64.b64encode(gzip.compress(b"AKIA" + b"B" * 20, mtime=0))
        text = base64.b64encode(gzip.compress(inner, mtime=0)).decode()
        assert secretscan.find(text).spans == [("assign", 0, len(text)), ("access", 0, len(text))]


@pytest.mark.parametrize("data", [b"\x00\xff\xfe\x80 binary " + SECRET.encode() + b" \xc3\x28", SECRET.encode("utf-16-le"), gzip.compress(b"\xff" * 50 + SECRET.encode(), mtime=0), gzip.compress(b"first", mtime=0) + SECRET.encode()])
def test_layers_that_are_no_text(data):
    text = base64.b64encode(data).decode()
    assert ("assign", 0, len(text)) in secretscan.find(text).spans


@pytest.mark.parametrize("text", ['password="%68unter2hunter2"', "password = %68unter2hunter2", "p%2561ssword%20%3D%20hunter2hunter2", "\\u005cu0070assword: hunter2hunter2", "&amp;#112;assword: hunter2hunter2"])
def test_keyword_and_value_around_escapes(text):
    assert {(a, b) for _, a, b in secretscan.find(f"x\n{text}\ny").spans} == {(2, 2 + len(text.rstrip('"')))}


def test_many_steps_in_one_pass():
    began = time.time()
    for text in ("%25" * 330_000 + "41KIA" + "A" * 20, "%" + "25" * 500_000 + "41KIA" + "A" * 20, "\\" + "u005c" * 200_000 + "u0041KIA" + "A" * 20, "&" + "amp;" * 250_000 + "#65;KIA" + "A" * 20):
        found = secretscan.find(text).spans
        assert any(kind == "access" and b == len(text) for kind, _, b in found)
    assert secretscan.find("a " * 500_000 + "%41 &amp; \n").spans == []
    assert time.time() - began < 120


def test_nested_encodings_against_their_construction():
    """The expected spans are known as each layer is built: the whole region for base64, the decoded match for escapes."""
    r = random.Random(9)
    for _ in range(60):
        inner, exact = "password=hunter2hunter2", True
        for _ in range(r.randrange(1, 5)):
            kind = r.choice(["percent", "unicode", "base64", "gzip", "bz2"])
            if kind == "percent":
                inner = "".join(f"%{b:02X}" for b in inner.encode())
            elif kind == "unicode":
                inner = "".join(f"\\u{ord(c):04x}" for c in inner)
            else:
                exact = False
                pack = {"base64": lambda x: x, "gzip": lambda x: gzip.compress(x, mtime=0), "bz2": bz2.compress}[kind]
                inner = base64.b64encode(pack(inner.encode())).decode()
        spans = secretscan.find(f"see {inner} here").spans
        whole = [(a, b) for k, a, b in spans if k == "assign"]
        assert whole and min(a for a, _ in whole) == 4 and max(b for _, b in whole) in ((4 + len(inner),) if exact else (4 + len(inner), 4 + len(inner.rstrip("="))))


def packed(data):
    """By kind; words before the data make Zstandard compress it."""
    zstandard = pytest.importorskip("zstandard")
    return {"gzip": gzip.compress(data, mtime=0), "zlib": zlib.compress(data), "bzip2": bz2.compress(data), "zstd": zstandard.ZstdCompressor(write_checksum=True).compress(data)}


def flipped(data, k):
    return data[:k] + bytes([data[k] ^ 255]) + data[k + 1 :]


WORDY = noise(60) + b"\n" + SECRET.encode()


@pytest.mark.parametrize("kind, at", [("gzip", -8), ("gzip", -1), ("zlib", -1), ("bzip2", -2), ("bzip2", 12), ("zstd", -1)])
def test_wrong_checksums_are_told_and_hide_nothing(kind, at):
    data = packed(WORDY + b"\n")[kind]
    text = "see " + base64.b64encode(flipped(data, at if at > 0 else len(data) + at)).decode()
    found = secretscan.find(text)
    assert ("assign", 4, len(text)) in found.spans and found.broken == [(4, len(text))]
    assert secretscan.find(base64.b64encode(data).decode()).broken == []


@pytest.mark.parametrize("kind", ["gzip", "zlib", "bzip2", "zstd"])
def test_broken_data_give_what_is_before_the_break(kind):
    r = random.Random(4)
    data = packed(SECRET.encode() + b"\n" + bytes(r.choice(b"ABC DEF,") for _ in range(2_000_000)))[kind]
    for broken in (data[:-9000], flipped(data, len(data) - 9000), data[:-9000] + b"\xff" * 20):
        ends = []
        got = b"".join(secretscan._inflate(broken, ends))
        assert ends == [False] and got.startswith(SECRET.encode()) and len(got) > 800_000
    plain = base64.b64encode(packed(b"first")[kind][:-1] + b"\n\xff" + SECRET.encode()).decode()
    found = secretscan.find(plain)
    assert ("assign", 0, len(plain)) in found.spans and found.broken == [(0, len(plain))]


def test_what_follows_a_frame():
    frame, skippable = packed(WORDY)["zstd"], b"\x50\x2a\x4d\x18\x04\0\0\0note"
    first = packed(noise(40))["zstd"]
    for data in (frame + b" and plain words", frame + b"\0" * 9, first + b"\0" * 9 + frame, first + gzip.compress(WORDY, mtime=0), first + skippable + frame, skippable + frame, first + SECRET.encode()):
        text = base64.b64encode(data).decode()
        found = secretscan.find(text)
        assert ("assign", 0, len(text)) in found.spans and found.broken == []


def test_wide_windows():
    zstandard = pytest.importorskip("zstandard")
    wide = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(window_log=28, write_content_size=False)).compressobj()
    text = base64.b64encode(wide.compress(WORDY) + wide.flush()).decode()
    found = secretscan.find(text)
    assert ("assign", 0, len(text)) in found.spans and found.broken == []


def test_faults_of_the_machine_are_errors(monkeypatch):
    data = packed(WORDY)
    text = {k: base64.b64encode(x).decode() for k, x in data.items()}
    monkeypatch.setitem(sys.modules, "zstandard", None)
    with pytest.raises(ImportError):
        secretscan.find(text["zstd"])

    def decoder(error):
        def decompress(*_):
            raise error

        return lambda *_: types.SimpleNamespace(decompress=decompress)

    for error in (MemoryError(), zlib.error("Error -4 while decompressing data")):
        monkeypatch.setattr(secretscan.zlib, "decompressobj", decoder(error))
        with pytest.raises(MemoryError):
            secretscan.find(text["gzip"])
    monkeypatch.setattr(secretscan.bz2, "BZ2Decompressor", decoder(MemoryError()))
    with pytest.raises(MemoryError):
        secretscan.find(text["bzip2"])


def test_regions_that_are_told_as_broken():
    good = gzip.compress(WORDY, mtime=0)
    bad = flipped(good, len(good) - 8)
    run = base64.b64encode(good).decode()
    assert secretscan.find(f"See below:\n{wrap(good)}\nRegards").broken == []  # its lines are no regions
    assert secretscan.find(run.replace("+", "%2B").replace("/", "%2F").replace("=", "%3D")).broken == []  # nor are its parts
    two = f"a:\n{wrap(good)}\n{wrap(bad)}"
    assert secretscan.find(two).broken == [(len(two) - len(wrap(bad)), len(two))]
    text = "x " + base64.b64encode(b"see " + base64.b64encode(bad)).decode()
    assert secretscan.find(text).broken == [(2, len(text))]
    text = base64.b64encode(gzip.compress(bad, mtime=0)).decode()
    assert secretscan.find(text).broken == [(0, len(text))]


def test_broken_regions_in_the_rows(spark):
    data = packed(WORDY)["gzip"]
    texts = ["plain", base64.b64encode(data).decode(), "a " + base64.b64encode(data[:-12]).decode(), None]
    rows = secretscan.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.broken for r in rows] == ["", "", f"2:{len(texts[2])}", ""]


def test_a_long_run_beside_a_line_break():
    began = time.time()
    data = gzip.compress(b"A" * 1_000_000 + b" " + SECRET.encode(), mtime=0)
    text = base64.b64encode(flipped(data, len(data) - 8)).decode()
    found = secretscan.find(text)
    assert ("assign", 0, len(text)) in found.spans and found.broken == [(0, len(text))]
    assert time.time() - began < 30

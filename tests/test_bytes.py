"""Codecs, scans, the legacy reader and the commands."""

import math
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.plans import surface
from lodestone.sources import codecs, columns, files, legacy, scans


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40))
def test_lz4_round_trip(data, times):
    data = data * times
    packed = codecs.lz4_encode(data)
    assert codecs.lz4_decode(packed + b"rest", len(data))[0] == data
    if data:
        assert codecs.lz4_decode(packed, len(data))[1] == len(packed)


def test_lz4_rejects():
    for raw, size in ((b"\x10", 5), (b"\x00\x00\x00", 4), (b"\xf0", 30), (b"", 1)):
        with pytest.raises(codecs.CodecError):
            codecs.lz4_decode(raw, size)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**64 - 1))
def test_varuint(value):
    assert codecs.varuint_decode(b"x" + codecs.varuint_encode(value), 1) == (value, 1 + len(codecs.varuint_encode(value)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_fpc(patterns):
    assert codecs.fpc_decode(codecs.fpc_encode(patterns), len(patterns))[0] == patterns


def test_fpc_known():
    assert codecs.double_bits(500.0) == "407f400000000000"
    bits = codecs.patterns([500.0, 1000.0, 1500.0])
    assert codecs.doubles(codecs.fpc_decode(codecs.fpc_encode(bits), 3)[0]) == [500.0, 1000.0, 1500.0]
    with pytest.raises(codecs.CodecError):
        codecs.fpc_decode(codecs.fpc_encode(bits)[:-1], 3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(1, 150)), max_size=20))
def test_byte_runs(runs):
    data = b"".join(bytes([b]) * n for b, n in runs)
    assert codecs.byte_runs_decode(codecs.byte_runs_encode(data))[0] == data


def test_byte_runs_known():
    data = b"<x>\x03abc\xc29\x00tail"
    out, source, why = codecs.byte_runs_decode(data, 3, 100, stop=True)
    assert out == b"<x>abc99999" and source[-5:] == [108] * 5 and why == "control_0x00"
    assert [codecs.byte_runs_decode(bytes([c]) + b"9")[0] for c in (0xC0, 0xCB, 0xCC)] == [b"9" * 3, b"9" * 14, b"9" * 15]
    with pytest.raises(codecs.CodecError):
        codecs.byte_runs_decode(b"\x80")


def test_strings_and_tables():
    raw = b"\0\0alpha\1" + b"\2" * 5 + b"bravo-charlie\0tail"
    assert scans.string_spans(raw) == [(2, "alpha"), (13, "bravo-charlie"), (27, "tail")]
    found = scans.numeric_tables(b"header\n1 2 3\n4 5 6\nnot-a-table\n7 8 9\n10 11 12\n", 2, 2)
    assert [(t, r, v) for t, r, _, v in found] == [(1, 1, ["1", "2", "3"]), (1, 2, ["4", "5", "6"]), (2, 1, ["7", "8", "9"]), (2, 2, ["10", "11", "12"])]
    assert [o for _, _, o, _ in found] == [7, 13, 31, 37]
    assert scans.numeric_tables(b"abc\ndef\n", 3, 4) == []
    assert [t for t, *_ in scans.numeric_tables(b"1 2\nx\n1;1e5\n.5,nan\n", 2, 2)] == [2, 2]


def test_tagged_fields():
    assert scans.tagged_strings(b'prefix\x05\x80*Name\0\x05\x80+bad\1\0', 100) == [(109, 5, 0x2A, "Name")]
    raw = bytes.fromhex("28c011060000010 04b0000".replace(" ", "")) + b"\x2d\xc0\x11\x0d\1\0\1\0" + struct.pack("<d", 37.5) + b"\0"
    assert [(f, n) for _, f, n, _ in scans.tagged_scalars(raw)] == [(0x28, 6), (0x2D, 13)]


def png():
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b"")


def test_images_and_containers():
    image = png()
    assert scans.images(b"xx" + image + b"yy" + image[:-3]) == [("png", 2, len(image), True), ("png", 4 + len(image), len(image) - 3, False)]
    assert scans.images(b"<SVG a>b</svg >!") == [("svg", 0, 15, True)]
    packed = zlib.compress(b"hello" * 50)
    assert ("zlib_like", 3, len(packed), 0.88) in scans.containers(b"\0\1\2" + packed + b"\3")
    assert scans.detect(b"CPYUA 4.3")[0] == "unicode_project" and scans.detect(b"CPYA 4.2")[0] == "legacy_project" and scans.detect(b"?")[0] == "unknown"
    assert scans.entropy(b"") == 0 and scans.entropy(bytes(range(256))) == 8


def project():
    a = legacy.pack_dataset("Book1_A", struct.pack("<4d", 1.5, legacy.MISSING, -2.0, 0.0), 4, 8)
    b = legacy.pack_dataset("Book1_B@2", struct.pack("<3H", 1, 65535, 7), 3, 2, unsigned=True)
    text = b"".join(x.ljust(12, b"\0") for x in (b"\1\0one", b"\0\0" + struct.pack("<d", 4.25), b"\1\0"))
    c = legacy.pack_dataset("Book1_C", text, 3, 12, 0x100)
    return legacy.pack_file([a, b, c], legacy.pack_frame(b"Graph1\0more") + legacy.pack_frame(b""))


def test_legacy_cells():
    got = list(legacy.cells(project()))
    assert [x[3:] for x in got if x[1] == "Book1_A"] == [("float", 1.5, None, None), ("missing", None, None, None), ("float", -2.0, None, None), ("float", 0.0, None, None)]
    assert [x[5] for x in got if x[1] == "Book1_B@2"] == [1, 65535, 7]
    assert [(x[3], x[4], x[6]) for x in got if x[1] == "Book1_C"] == [("text", None, "one"), ("float", 4.25, None), ("text", None, "")]
    kinds = [e["kind"] for e in legacy.elements(project(), tolerant=False)]
    assert kinds == ["global_header", "dataset", "dataset", "dataset", "object", "list_end"]


def test_truncation_is_definitive_only_past_the_end():
    data = project()
    assert legacy.truncated_at(data) is None
    r = random.Random(1)
    for cut in [len(data) // 3, len(data) // 2] + [r.randrange(60, len(data) - 30) for _ in range(20)]:
        assert legacy.truncated_at(data[:cut]) is not None or list(legacy.elements(data[:cut]))
    broken = bytearray(data)
    broken[data.index(b"\n") + 5] = 0x20
    assert legacy.truncated_at(bytes(broken)) is None
    with pytest.raises(legacy.Damaged):
        list(legacy.elements(bytes(broken), tolerant=False))


def test_commands(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.opj").write_bytes(project() + png())
    (folder / "b.bin").write_bytes(b"1 2\n3 4\n5 6\n7 8\n9 1\n")
    (folder / "c.opj").write_bytes(b"C")
    found = {r.path.rsplit("/", 1)[1]: r for r in surface.inspect(spark, str(folder)).collect()}
    assert found["a.opj"].support == "parser" and found["a.opj"].n_datasets == 3 and found["a.opj"].n_images == 1
    assert found["b.bin"].detected_type == "unknown" and found["c.opj"].length == 1
    items = surface.catalog(spark, str(folder)).collect()
    assert len({r.id for r in items}) == len(items) >= 4
    image = next(r for r in items if r.kind == "image_png")
    assert bytes(surface.get(spark, str(folder), image.id).first().bytes) == png()
    out = {r.name: r.n_rows for r in surface.extract(spark, str(folder), str(tmp_path / "x")).collect()}
    assert out["cells"] == 10 and out["numeric_tables"] == 5 and out["files"] == 3
    surface.extract(spark, str(folder), str(tmp_path / "y"))
    assert surface.compare(spark, str(tmp_path / "x"), str(tmp_path / "y")).count() == 0
    with pytest.raises(Exception, match="exists"):
        surface.extract(spark, str(folder), str(tmp_path / "x"))
    content = files.binary_files(spark, str(folder), "b.bin")
    assert bytes(content.select(files.byte_range(content["content"], 4, 3)).first()[0]) == b"3 4"
    with pytest.raises(Exception, match="past the end"):
        content.select(files.byte_range(content["content"], 4, 300)).collect()


def test_compressed_regions(spark):
    xml = b"<OriginStorage><a>" + b"value " * 40 + b"</a></OriginStorage>"
    packed = codecs.lz4_encode(xml)
    at = packed.index(b"<OriginStorage")
    df = spark.createDataFrame([("f", b"junk" + len(xml).to_bytes(4, "little") + packed + b"tail")], "path string, content binary")
    got = files.lz4_blocks(df).collect()
    assert at == 2 and [bytes(r.payload) for r in got] == [xml] and got[0].start == 8 and got[0].end == 8 + len(packed)


def test_arrivals(spark, tmp_path):
    from lodestone.streaming import arrivals

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.bin").write_bytes(project())
    for n in (1, 2):
        arrivals.catalog_arrivals(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (folder / "b.bin").write_bytes(b"CPYUA 4.3 1#\n")


def values(raw):
    column = columns.decode(raw)
    return None if column is None else [c.value for c in column.cells]


def test_known_columns():
    half, gone = struct.pack("<d", 0.5), struct.pack("<d", legacy.MISSING)
    one = bytes.fromhex("0a0501ffff0100010c07") + struct.pack("<d", 500.0) + b"\xce"
    assert values(one) == [500.0] and columns.decode(one).encoding == "fpc-fcm-dfcm"
    prefix = bytes.fromhex("0a0504ffff0300041af03f010c07") + half + bytes.fromhex("ffff01010200ce")
    assert values(prefix) == [1.0, 1.0, 0.5, None]
    segmented = bytes.fromhex("0a0504ffff0200021af03f010c07") + gone + bytes.fromhex("010000ffff01010200ce")
    assert values(segmented) == [1.0, None, None, None]
    texts = bytes.fromhex("0a0504ffff04010505") + b"alpha\0\x04beta" + bytes.fromhex("0200ce")
    assert values(texts) == ["alpha", "", "beta", None] and columns.decode(texts).encoding == "utf8-sequence"
    integers = bytes.fromhex("0a041effff1e01050100003600ce")
    assert values(integers) == [1, 0, 0] + [None] * 27 and columns.value_type(columns.decode(integers)) == "unsigned_integer"
    assert values(bytes.fromhex("0a050101 0000ce".replace(" ", ""))) == [None]
    assert values(bytes.fromhex("0a0520ffff20014000ce")) == [None] * 32 and columns.decode(bytes.fromhex("0a0520ffff20014000ce")).encoding == "empty"
    compact = bytes.fromhex("0a0503") + b"\0\0\x64" + b"\0\0\x1a\xf0\x3f" + bytes.fromhex("ffff01010200ce")
    assert values(compact) == [0.0, 1.0, None]
    for raw in (one[:-1], one + b"x", texts[:-2] + b"\xce", b"\x0a\x05", b"", b"\x0a\x06\x01\xce", one[:-9] + struct.pack("<d", math.inf) + b"\xce"):
        assert columns.decode(raw) is None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=40))
def test_number_columns(cells):
    stored = [None if v == columns.MISSING else v for v in cells]  # the format's own mark of a missing value
    assert [None if v is None else codecs.patterns([v]) for v in values(columns.encode_numbers(cells))] == [None if v is None else codecs.patterns([v]) for v in stored]

"""The unicode project reader against its own packer, and on damaged bytes."""

import struct

from lodestone.sources import columns, unicode


def test_columns_and_regions():
    a, b = columns.encode_numbers([1.5, None, 3.0]), columns.encode_numbers([None] * 4)
    text = b"<OriginStorage>x<ORIGINSTORAGE>y</originstorage></OriginStorage>"
    data = unicode.pack_file([unicode.pack_column("Book1_A", a), unicode.pack_column("N2N_B", b, b"\0" * 16), bytes(70), unicode.pack_column("C_far", a), text, unicode.pack_region(text)])
    found = list(unicode.descriptors(data))
    assert [d["name"] for d in found] == ["Book1_A", "N2N_B", "C_far"]
    assert [[c.value for c in d["column"].cells] for d in found] == [[1.5, None, 3.0], [None] * 4, [1.5, None, 3.0]]
    assert found[1]["start"] == found[0]["end"] and found[2]["start"] > found[1]["end"]  # a near gap belongs to the column, a far one doesn't
    regions = [data[x:y] for x, y in unicode.raw_regions(data)]
    assert text in regions
    assert [p for _, _, p in unicode.decoded_regions(data)] == [text]
    kinds = [k for _, _, k, _ in unicode.walk(data)]
    assert kinds.count("column") == 3 and kinds.count("decoded_region") == 1 and kinds.count("raw_region") == 1
    reach = 0
    for x, y, *_ in unicode.walk(data):
        assert x <= reach
        reach = max(reach, y)
    assert reach == len(data)


def test_damage():
    good = unicode.pack_column("Book1_A", columns.encode_numbers([1.0]))
    assert list(unicode.descriptors(b"CPYUA 4 200\n" + good[:-1])) == []  # the payload runs past the end
    assert list(unicode.descriptors(unicode.ROW_PREFIX + good[8:])) == []  # no name
    bad = unicode.pack_column("Book1_A", b"\x0a\x05\x01nonsense")
    assert [d["column"] for d in unicode.descriptors(bad)] == [None]
    assert list(unicode.walk(b"")) == [] and list(unicode.walk(b"CPYA 4 2#\n")) == []
    assert list(unicode.raw_regions(b"<OriginStorage>open")) == []
    assert list(unicode.raw_regions(b"<originstorage><originstorage></originstorage>tail")) == [(0, 46)]


def test_parameters_and_blocks():
    data = unicode.pack_parameters([("a", 1.5), ("9bad", 2.0), ("_c", -1.0)])
    assert [(n, v) for n, v, *_ in unicode.parameters(data)] == [("a", 1.5), ("_c", -1.0)]
    at = next(unicode.parameters(data))[2]
    assert data[at : at + 2] == b"a\n" and struct.unpack_from("<d", data, at + 2)[0] == 1.5
    assert list(unicode.parameters(b"x")) == []
    blocks = b"CPYA 4 2#\n" + b"\x07" + (3).to_bytes(4, "little") + b"\nabc\n" + (9).to_bytes(4, "little") + b"\nshort"
    assert [p for *_, p in unicode.length_blocks(blocks)] == [b"abc"]

"""Commands over files of both formats, and their exit codes."""

import io
import json

from lodestone.plans import dispatch, surface
from lodestone.sources import columns, legacy, unicode


def test_commands(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    column = unicode.pack_column("Book1_A", columns.encode_numbers([1.0, None]))
    (good / "a.opju").write_bytes(unicode.pack_file([column, b"<OriginStorage>t</OriginStorage>", b"<svg>x</svg>"]))
    (good / "b.opj").write_bytes(legacy.pack_file([legacy.pack_dataset("Book1_A", b"\1\0\2\0", 2, 2)]))
    run = lambda *argv: (dispatch.main([*argv], spark, out := io.StringIO()), [json.loads(x) for x in out.getvalue().splitlines()])
    code, rows = run("walk", str(good))
    assert code == 0 and {r["kind"] for r in rows} >= {"header", "column", "raw_region", "dataset", "global_header"}
    code, rows = run("list", str(good))
    assert code == 0 and {r["kind"] for r in rows} >= {"worksheet_column", "raw_region", "image_svg"}
    item = next(r for r in rows if r["kind"] == "image_svg")
    code, rows = run("get", str(good), item["id"])
    assert code == 0 and bytes.fromhex(rows[0]["bytes"]) == b"<svg>x</svg>"
    names = {r["artifact"]: r["bytes"] for r in map(lambda r: r.asDict(), surface.artifacts(spark, str(good)).collect())}
    assert any(n.endswith(".svg") and bytes(b) == b"<svg>x</svg>" for n, b in names.items())
    assert run("strings", str(good), "--least", "0")[0] == dispatch.USAGE and run("nonsense")[0] == dispatch.USAGE
    assert run("dump-block", str(good / "b.opj"), "0", "4")[1][0]["bytes"] == b"CPYA".hex()
    assert run("dump-block", str(good / "b.opj"), "0", "999999")[0] == dispatch.USAGE
    assert run("table-scan", str(good))[0] == dispatch.UNSUPPORTED
    assert run("inspect", str(tmp_path / "none"))[0] == dispatch.FAILED
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        assert run("xlsx", str(good), str(tmp_path / "x.xlsx"))[0] == dispatch.DEPENDENCY
    out = str(tmp_path / "out")
    assert run("extract", str(good), out)[0] == 0
    cells = spark.read.parquet(f"{out}/cells")
    assert sorted((r["kind"], r["f64"] or r["i64"] or 0) for r in cells.collect()) == [("float", 1.0), ("integer", 1), ("integer", 2), ("missing", 0)]
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "c.opj").write_bytes((good / "b.opj").read_bytes()[:-40])
    assert run("inspect", str(tmp_path / "cut"))[0] == dispatch.CORRUPT

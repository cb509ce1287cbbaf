"""What a Python worker of the pipeline holds at its peak, and when its task is over."""

import pathlib
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm import mixing as M

POOL = pa.proxy_memory_pool(pa.default_memory_pool())  # outlives what is allocated in it
ROOT = str(pathlib.Path(__file__).resolve().parents[2])
JUDGED = """
import re
from types import SimpleNamespace
import numpy as np, pyarrow as pa
from lodestone.llm import quality as Q

def mb(file, name):
    return int(re.search(name + r":\\s+(\\d+)", open(f"/proc/self/{file}").read())[1]) / 1024

models = {k: (np.zeros(Q.FEATURES, np.float32), 1.0, 1.0, 0.0) for k in ("quality", "toxic")}
Q._models = lambda *a: (None, SimpleNamespace(value=models))
docs = SimpleNamespace(columns=["doc_id", "text"], schema=None, mapInArrow=lambda run, schema: run)
run = Q.good_documents(docs, None)
words = np.random.default_rng(1).integers(10_000, 99_999, (8_000, 90)).astype(str)
batch = pa.RecordBatch.from_arrays([pa.array(range(8_000)), pa.array([" ".join(x) for x in words])], names=docs.columns)
del words
sum(x.num_rows for x in run(iter([batch.slice(0, 5)])))  # tables that stay
pa.default_memory_pool().release_unused()
__import__("ctypes").CDLL(None).malloc_trim(0)
before = mb("smaps_rollup", "Pss_Anon")
open("/proc/self/clear_refs", "w").write("5")
low = mb("status", "VmHWM")
sum(x.num_rows for x in run(iter([batch])))
print(mb("status", "VmHWM") - low, mb("smaps_rollup", "Pss_Anon") - before)
"""


def test_judged_texts_are_given_back():
    """Over 4 MB of texts: 220 MB at the peak and 108 MB afterwards when they were judged together and nothing given back."""
    said = subprocess.run([sys.executable, "-c", JUDGED], cwd=ROOT, capture_output=True, text=True, timeout=300)
    peak, after = map(float, said.stdout.split())
    assert peak < 90 and after < 20, (peak, after)


def test_parts_do_not_take_whole_texts():
    """The mix of a long document takes memory for its parts, not for a whole text with each part."""
    words, block = 40_000, 128
    docs = pa.table({"doc_id": [1, 2], "text": [" ".join(map(str, range(words))), "a b"], "carried": [{"lang": "en"}, {"lang": None}], "source_no": [0, 0], "segment": [0, 0]})
    n = -(-(words + 2) // block)
    slots = pa.table({"block": pa.array(range(n)), "shard": pa.array(np.zeros(n, np.int64)), "slot": pa.array(range(n))})
    names = ["source_no", "segment", "row", "doc_id", "size", "shard", "slot", "place", "words", "part", "carried"]
    old = pa.default_memory_pool()
    pa.set_memory_pool(POOL)
    try:
        out = M._deal(block, names)(docs, slots)
    finally:
        pa.set_memory_pool(old)
    parts = out.filter(pc.is_valid(out.column("shard"))).to_pylist()
    assert "".join(x["part"] for x in parts if x["doc_id"] == 1) == docs.column("text")[0].as_py()
    assert sum(x["words"] for x in parts) == words + 2 and {x["doc_id"]: x["carried"] for x in parts} == {1: {"lang": "en"}, 2: {"lang": None}}
    assert POOL.max_memory() < 10 << 20, POOL.max_memory()


def test_scratch_tables_are_few_files(spark, tmp_path, monkeypatch):
    """Each file that an executor makes starts processes: no checksum files, and one file for the labels of a few edges."""
    from lodestone.llm import url_filters
    from lodestone.operators import shared

    paths = []
    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(shared, "_delete_at_end", lambda spark, path: paths.append(pathlib.Path(path)))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 7] + [(90, 80)], "a bigint, b bigint").repartition(4)
    got = {r.node: r.component for r in url_filters.components(edges).collect()}
    assert got == {i: max(1, (i - 1) // 7 * 7 + 1) for i in range(1, 41)} | {80: 80, 90: 80}
    assert len(paths) > 3 and not [x for p in paths for x in p.rglob(".part*")]
    assert all(len(list(p.glob("part*"))) == 1 for p in paths if "label" in p.name)

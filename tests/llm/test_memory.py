"""What a Python worker holds on to beside its executor, after a task and within one."""

import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[2])
MEASURE = r"""
import re
from types import SimpleNamespace
import pyarrow as pa
from lodestone.llm import toxicity, ngram_join

def mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

session = SimpleNamespace(sparkContext=SimpleNamespace(environment={}))
docs = SimpleNamespace(columns=["doc_id", "text"], schema=None, sparkSession=session, mapInArrow=lambda run, schema: run)
model = toxicity.Model({c: 5.0 for c in toxicity.Cells()(b"vile")} if hasattr(toxicity, "Cells") else {c: 5.0 for c in toxicity.cells(b"vile")}, -3.0)
run = toxicity.drop_toxic(docs, model)

def batch(first, rows):
    texts = [f"{'vile ' if i % 10 == 0 else ''}" + " ".join(f"word{i}x{k}" for k in range(100)) for i in range(first, first + rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + rows), pa.int64()), pa.array(texts)], ["doc_id", "text"])

list(run(iter([batch(0, 20)])))
whole = batch(1000, 4500)
before, kept, most = mb(), [], 0
for out in run(iter([whole])):
    kept += out.column(0).to_pylist()
    most = max(most, out.num_rows)
    del out
assert kept == [i for i in range(1000, 5500) if i % 10], len(kept)
print(mb() - before, most)
"""


def test_toxicity_worker_gives_memory_back():
    """450,000 words remembered beyond their task, in each worker, were part of what stopped ``pipeline``."""
    out = subprocess.run([sys.executable, "-c", MEASURE], cwd=REPO, env={"PYTHONPATH": REPO, "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    grown, most = map(float, out.stdout.split())
    assert grown < 25, f"{grown:.0f} MB"
    assert most <= 512  # rows that come back at once, texts and all

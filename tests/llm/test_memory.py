"""What kernels hold when they have ended, in a process of its own as a worker is."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
#: Freed memory that the C library keeps: many small blocks under one that lives.
STEP = """
import re
import pyarrow as pa
from graphloom.llm import _bytes

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def run(batches):
    for batch in batches:
        words = [bytes(1000) for _ in range(100_000)]
        pin.append(bytes(1000))
        del words
        yield batch

pin, before = [], held()
list(getattr(_bytes, "tidy", lambda step: step)(run)([1, 2]))
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory cannot be read here")
def test_kernels_give_back_what_they_held():
    got = subprocess.run([sys.executable, "-c", STEP], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=60)
    assert float(got.stdout) < 40, got.stderr


def test_every_kernel_of_the_pipeline_is_tidy():
    for name in ("textcnn", "nearcopies", "decontaminate", "simple8b"):
        text = (ROOT / f"graphloom/llm/{name}.py").read_text()
        assert re.findall(r"mapInArrow\((\w+)\(", text) and not re.findall(r"mapInArrow\((?!tidy\(|with_set\()", text), name

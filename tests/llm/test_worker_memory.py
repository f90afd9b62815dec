"""What a task leaves in its worker: each case runs in a process of its own, so that nothing else is counted."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

ABOUT = """
import random, re, sys
import numpy as np, pandas as pd, public_tokenizers, pyarrow as pa
from inkwell.llm import crowds, near_dedup, token_output
from inkwell.llm.queries import TOKENIZER

r = random.Random(7)
vocabulary = ["".join(r.choices("abcdefghiklmnoprstuvwxyz", k=r.randint(2, 10))) for _ in range(20_000)]
texts = [" ".join(r.choices(vocabulary, k=300)) for _ in range(6_000)]
pool = pa.default_memory_pool()

def anonymous():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def tokens():
    def found():
        yield pa.record_batch({"doc_id": range(len(texts)), "text": texts, "shard": pa.array([0] * len(texts), pa.int32())})
    run = token_output.encoded_blocks(public_tokenizers.path(TOKENIZER), 1, 49_152, 1 << 16)
    return sum(block.num_rows for block in run(found()))

def signed():
    def found():  # as Spark reads them: Arrow's buffers are there until pandas has the rows
        yield pa.table({"doc_id": range(len(texts)), "text": texts}).to_pandas()
    return sum(map(len, near_dedup._signed(5, ["doc_id"])(found())))

n = {"tokens": tokens, "signed": signed}[sys.argv[1]]()
held, most = anonymous(), pool.max_memory() / 2**20
pool.release_unused()
print(n, held - anonymous(), most)
"""


def measured(case: str) -> tuple[int, float, float]:
    """Rows, MB that the pool still kept free after the task, and the most that it held meanwhile."""
    done = subprocess.run([sys.executable, "-c", ABOUT, case], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120, check=True)
    n, kept, most = done.stdout.split()
    return int(n), float(kept), float(most)


@pytest.mark.skipif(pa.default_memory_pool().backend_name == "system" or not Path("/proc/self/smaps_rollup").exists(), reason="nothing is kept, or it can't be read")
def test_tasks_leave_no_free_memory_in_arrows_pool():
    for case in ("tokens", "signed"):
        n, kept, _ = measured(case)
        assert n > 20 and kept < 8, (case, kept)


def test_encoding_holds_little_more_than_a_batch():
    _, _, most = measured("tokens")
    assert most < 40, most

"""What a Python worker remembers of words stays within its bound, and the ids do not depend on it."""

import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from roadframe.llm import packing
from roadframe.llm.queries import tokenizer_path


def test_few_remembered_words_give_the_same_ids():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["Strasse", "w", "x9"]) + str(rng.randrange(4_000)) for _ in range(300)) for _ in range(40)]
    wide, narrow = packing.Ids(tokenizer_path()), packing.Ids(tokenizer_path(), 1_000)
    for at in range(0, 40, 2):
        assert narrow.of(texts[at : at + 2]) == wide.of(texts[at : at + 2])
    # a generation is closed before the words of one call would exceed it; their stems and punctuation come on top
    assert len(narrow.known) + len(narrow.older) < 5_000 < len(wide.known)


def test_pipeline_bounds_the_memory_of_its_packing(monkeypatch):
    seen = {}
    monkeypatch.setattr(packing, "packed", lambda docs, path, **given: seen.update(given))
    corpus_pipeline.packing_stage(None, None, "")
    assert seen["with_ids"] and seen["remembered"] < packing.REMEMBERED


def test_a_task_gives_its_memory_back():
    """In a process of its own: what is left after ten batches of 30 MB is little, and no word stays known."""
    script = f"""
import re
import pyarrow as pa
from roadframe.llm import packing
from roadframe.llm.session import tidy

def held():
    return sum(map(int, re.findall(r"(?:Private_Dirty):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    for n in range(10):
        yield pa.RecordBatch.from_pydict({{"doc_id": pa.array(range(2000)), "text": pa.array(["x%d " % (n * 2000 + i) + "ab " * 5000 for i in range(2000)])}})

def copied(found):
    for b in found:
        yield b.filter(pa.array([i % 3 > 0 for i in range(b.num_rows)]))

before = held()
assert sum(b.num_rows for b in tidy(copied)(batches())) == 13_330
assert held() - before < 60, held() - before
small = [pa.RecordBatch.from_pydict({{"doc_id": [1], "text": ["some words"]}})]
path = {tokenizer_path()!r}
assert sum(b.num_rows for b in packing._pieces(iter(small), path, True, 1_000)) == 1
assert not packing._ids(path, 1_000).known
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=Path(corpus_pipeline.__file__).parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr

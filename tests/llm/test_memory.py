"""What a worker keeps between tasks goes back to the system when another stage begins."""

import subprocess
import sys

from playtrail.llm import common, passages
from playtrail.llm.passages import Windows
from playtrail.llm.quality_rules import _counter, text_statistics

# The last piece lies behind all others, so the heap cannot shrink from its end alone.
SWITCH = """
import re
from playtrail.llm.common import kept

def held():
    with open("/proc/self/smaps_rollup") as file:
        return int(re.search(r"Pss_Anon:\\s+(\\d+)", file.read())[1]) // 1024

last = []
def make():
    table = [bytes(2000) for _ in range(80_000)]
    last.append(bytes(2000))
    return table

kept("first", make)
full = held()
kept("second", list)
print(full - held())
"""


def test_memory_of_an_earlier_stage_is_handed_back():
    run = subprocess.run([sys.executable, "-c", SWITCH], capture_output=True, text=True, check=True)
    assert int(run.stdout) > 100


def test_quality_rules_begin_with_nothing_kept():
    common.kept("an earlier stage", list)
    assert _counter() is text_statistics
    assert not common._KEPT


def test_windows_hold_no_words_unless_asked():
    texts = [b"a b c d", None, b"b c d e"]
    whole, lean = Windows(texts, 3), Windows(texts, 3, with_words=False)
    assert lean.words is None and lean.n_words == len(whole.words)
    assert (lean.first == whole.first).all() and (lean.second == whole.second).all()
    repeated = lean.first == lean.first[1]
    assert (lean.covered(repeated, 3) == whole.covered(repeated, 3)).all()


def test_words_of_a_block_are_split_by_portions(monkeypatch):
    texts = [b" ".join(b"%d" % (n * 7 + k) for k in range(20)) for n in range(40)] + [None, b"0 1"]
    common.forget()
    whole = Windows(texts, 3, with_words=False)
    monkeypatch.setattr(passages, "PORTION_BYTES", 100, raising=False)
    monkeypatch.setattr(passages, "MAX_WORDS", 50)
    common.forget()
    lean = Windows(texts, 3, with_words=False)
    # A block of 293 words: the table holds no more than the limit and two portions.
    assert len(common.kept("word prints", dict)) <= 150
    for name in ("starts", "first", "second", "begins", "ends", "counts"):
        assert (getattr(lean, name) == getattr(whole, name)).all()

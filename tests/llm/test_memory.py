"""What a Python worker takes while it encodes."""

import subprocess
import sys

import pytest

from barweave.llm.encoding import vocabulary_path

ENCODE = """
import random, resource, sys
import pyarrow as pa
from barweave.llm.encoding import encoder, rebatched

r, enc = random.Random(1), encoder(sys.argv[1], sys.argv[2] == "1")
known = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 7))) for _ in range(20_000)]
def batches():  # 24 MB, a word in seven is met once
    for _ in range(24):
        texts = [" ".join(r.choice(known) if r.random() < 6 / 7 else "".join(r.choices("qrstuvwxyz", k=8)) for _ in range(400)) for _ in range(440)]
        yield pa.record_batch([pa.array(texts)], ["text"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for b in rebatched(batches()):
    enc.encode_all(b.column(0))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize(("vocabulary", "blanks"), [("word_bpe_49k.json", "0"), ("byte_bpe_50k.json", "1")])
def test_a_worker_encodes_in_little_memory(vocabulary, blanks):
    """Two workers and a JVM of 1.8 GB share an executor of 3 GB."""
    done = subprocess.run([sys.executable, "-c", ENCODE, vocabulary_path(vocabulary), blanks], capture_output=True, text=True, check=True, timeout=300)
    assert int(done.stdout) < 250


def test_suffixes_of_strings_that_are_too_short_are_not_sorted(spark, monkeypatch, tmp_path):
    """Passages of 140 bytes between other words recur, but no 200 bytes do; and sorts leave none of their tables."""
    import random

    from barweave.llm import _common, suffix_dedup

    r = random.Random(5)
    text = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passages, whole = [text(140) for _ in range(20)], text(900)
    rows = [(k, "".join(text(300) + r.choice(passages) for _ in range(4)) + (whole if k < 2 else "")) for k in range(120)]
    sorted_, kept, sort = [], [], suffix_dedup.suffix_order
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda s, *a: sorted_.append(s.count()) or sort(s, *a))
    path = suffix_dedup.Scratch.keep
    monkeypatch.setattr(_common.Scratch, "keep", lambda self, d, name: kept.append(self) or path(self, d, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in suffix_dedup.removed_digest(docs).collect()}
    assert {k: n for k, n in got.items() if n} == {0: 900, 1: 900}
    assert sorted_[0] < 120
    assert not [p for _, p in kept[0].paths.values() if "/ranged-" in p or "/ranges-" in p]

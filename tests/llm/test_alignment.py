"""Token alignment against whole texts encoded by both libraries and aligned by their ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import alignment, queries
from barweave.llm.encoding import vocabulary_path

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def printable_bytes():
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(b): b for b in prints}
    for b in range(256):
        if b not in prints:
            chars[chr(0x100 + len(chars) - len(prints))] = b
    return chars


def whole_texts(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of_char = printable_bytes()
    every = []
    for doc_id, text in rows:
        groups = []
        if text:
            raw = (" " + text).encode()
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ta = [bytes(of_char[c] for c in a.id_to_token(i)) for i in ia]
            tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(ta) == raw == b"".join(tb):
                ends_a, ends_b = {}, {}
                for ends, tokens in ((ends_a, ta), (ends_b, tb)):
                    n = 0
                    for k, t in enumerate(tokens):
                        n += len(t)
                        ends[n] = k + 1
                i = j = 0
                for end in sorted(ends_a.keys() & ends_b.keys()):
                    groups.append((ia[i : ends_a[end]], ib[j : ends_b[end]]))
                    i, j = ends_a[end], ends_b[end]
        every.append((doc_id, groups))
    counts = Counter((x[-1], y[-1]) for _, groups in every for x, y in groups)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = Counter()
    for doc_id, groups in every:
        links = [(x[-1], y[-1]) for x, y in groups]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[p] == most[p[1]] for p in links)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out[(doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), best, sum(counts[p] for p in links), digest)] += 1
    return out


def hard_texts():
    r = random.Random(4)
    words = ["the", "Étude", "naïve", "don't", "12,345", "漢字", "🙂", "é", "<|endoftext|>", "<s>", "</s>", "<0x41>", "x" * 60, "\x00", "a b", "ﬁ", "ß", "_", "q\x1cz", " ", "İ"]
    gaps = [" "] * 8 + ["  ", "   ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "  ", "  ", "\x85 ", "\x1c ", "　", ""]
    out = ["".join(r.choice(gaps) + (r.choice(words) if r.random() < 0.8 else "".join(r.choice("abAB.,'1 é") for _ in range(4))) for _ in range(r.randint(1, 30))) + r.choice(gaps) for _ in range(1500)]
    return [*out, None, "", " ", "  ", "\n", "a ", "a  ", " a", "a▁b", "a▁ b", "▁", "w " * 40_000, "z" * 30_000, "same words here", "same words here"]


@pytest.mark.parametrize("pairs", [1_000_000, 10])
def test_alignment(spark, monkeypatch, pairs):
    """With counts handed out, and with counts joined."""
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", pairs)
    rows = [*enumerate(hard_texts()), (None, "no id"), (None, "no id"), (3, "again")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("c") for c in ("row", "pair", "pairs", "times", "n", "best")}).repartition(3)
    got = Counter(tuple(r[c] for c in FIELDS) for r in alignment.token_alignment(d, A, B).collect())
    assert got == whole_texts(rows)
    assert alignment.token_alignment(d.limit(0), A, B).count() == 0


def test_labels_and_groups():
    labels = alignment.label_string(np.array([2, 3, 5]), np.array([1, 3, 4, 5]), 5)
    assert labels == b"baxbx" and [x.tolist() for x in alignment.group_sizes(labels)] == [[2, 1], [2, 2]]
    assert [x.tolist() for x in alignment.group_sizes(b"")] == [[], []]


def test_full_tables_give_the_same(monkeypatch):
    texts = hard_texts()[:300]
    tool = alignment.Aligner(A, B)
    want = tool.align(texts)
    monkeypatch.setattr(alignment, "MEMO_WORDS", 5)
    parts = [tool.align(texts[i : i + 20]) for i in range(0, 300, 20)]
    assert [x for p in parts for x in p[1]] == want[1] and len(tool.at) <= 5


def test_alignment_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r[c] for c in FIELDS) for r in queries.op13_token_alignment(spark, sf).collect())
    assert got == whole_texts(rows) and sum(r[1] > 0 for r in got) > 100

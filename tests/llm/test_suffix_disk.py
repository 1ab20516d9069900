"""What the removal of repeated bytes leaves on disk, and how many windows it looks at one by one."""

import random
from collections import Counter

from barweave.llm import suffix_dedup
from test_suffix_dedup import FIELDS, all_windows


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))


def test_shuffle_files_go_and_few_windows_are_listed(spark, monkeypatch):
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    passages = [text(60) for _ in range(8)]
    rows = [(k, f"{text(30)} {passages[k % 8]} {text(30)}") for k in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    listed, windows = [], suffix_dedup._windows

    def counted(*given):
        found = windows(*given)
        listed.append(found.count())
        return found

    monkeypatch.setattr(suffix_dedup, "_windows", counted)
    before = shuffle_bytes(spark)
    info, texts, spans = suffix_dedup.repeated_spans(d)
    assert shuffle_bytes(spark) - before < 20_000
    monkeypatch.undo()
    got = Counter(tuple(x[c] for c in FIELDS) for x in suffix_dedup.removed_digest(d).collect())
    assert got == all_windows(rows)
    assert 0 < listed[0] < 40 * len(rows)


def test_a_code_of_many_rows_is_dealt_out(spark, monkeypatch):
    r = random.Random(6)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    line = text(60)
    rows = [(k, f"{text(10)} {line} {text(10)}") for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    most, marked = [], suffix_dedup._marked

    def counted(given, keys, *rest, **named):
        if keys == ["k"]:
            most.append(given.groupBy("k").count().agg({"count": "max"}).first()[0])
        return marked(given, keys, *rest, **named)

    monkeypatch.setattr(suffix_dedup, "_marked", counted)
    got = Counter(tuple(x[c] for c in FIELDS) for x in suffix_dedup.removed_digest(d).collect())
    assert got == all_windows(rows)
    assert most and most[0] <= 8

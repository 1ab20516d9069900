"""The text operators against brute force, round trips and hand-made edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barweave.llm import decontamination, encoding, ngram_join, packing, pseudonyms, quality_model, quality_rules, sharding, token_counts, token_files, toxicity
from barweave.llm.encoding import WordEncoder, vocabulary_path

WORD, BYTE = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n", "a", "a\nb", "  two  blanks ", "x" * 5000, "é ñ ß İ", "a\n\n\nb c", "don't stop", "1 2 3", "\tq\x1cz", "<|endoftext|>"]


def random_texts(n=60, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([1, 3, 8, 12, 40, 120, 400]))) for _ in range(n)]
    for i in range(0, n, 5):  # near copies
        w = texts[i].split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return texts + texts[:7] + ODD


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(random_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


FUZZ = ["the", "Word", "ÉTÉ", "naïve", "×2", "don't", "x.", "ok,", "A!", "12", "(b)", "é", "e\u0301", "漢字", "🙂", "a\u00a0b", "<|endoftext|>", ".", ",.", "İ", "ß", "q\x1cz", "w" * 50]
SPACES = [" "] * 12 + ["\n"] * 4 + ["  ", "\n\n", " \n", "\n ", "\t", "\r\n", " \t ", "\x0b", "\x0c\n", "\u2003", "\x85"]


def fuzzed(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [r.choice(["", "", *SPACES])]
        for _ in range(r.randint(1, 12)):
            parts += [r.choice(FUZZ) if r.random() < 0.8 else "".join(r.choice("abAB.,'1 é") for _ in range(r.randint(1, 5))), r.choice(SPACES)]
        out.append("".join(parts[: -1 if r.random() < 0.7 else None]))
    return out


@pytest.mark.parametrize(("path", "blanks"), [(WORD, False), (BYTE, True)])
@pytest.mark.parametrize("memo", [1_000_000, 40])
def test_words_encode_like_whole_texts(monkeypatch, path, blanks, memo):
    """Also with a memo that is full all the time, and in slabs of a few texts."""
    monkeypatch.setattr(encoding, "MEMO_WORDS", memo)
    monkeypatch.setattr(encoding, "JOINED", 3000)
    e = WordEncoder(path, blanks)
    texts = [*random_texts(), *fuzzed(3000, 1), "A\nB!\nÉté, ok\n12 a\n(b) c", "It's, he'd; we'll!", "y" * 100_000 + " z", "a b " * 50_000]
    want = [x.ids for x in e.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):
        got = e.encode_all(pa.array(texts, pa.string()))
        for t, ids, w in zip(texts, got, want, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == w, t
    assert e.encode_all(pa.array([], pa.string())) == [] and e.encode(None) == b""


def test_elias_fano_round_trip():
    r = np.random.default_rng(0)
    for n, top in [(1, 0), (1, 10**9), (5, 3), (1000, 50), (1000, 10**7)]:
        v = np.sort(r.integers(0, top + 1, n))
        e = token_files.EliasFano.from_bytes(token_files.EliasFano.of(v).to_bytes())
        assert e.all().tolist() == v.tolist()
        assert [e.get(i) for i in range(0, n, max(1, n // 97))] == v[:: max(1, n // 97)].tolist()
        for i, j in [(0, n), (n // 3, n // 2), (n - 1, n), (0, 0), (n // 2, min(n, n // 2 + 65))]:
            assert e.slice(i, j).tolist() == v[i:j].tolist()
    assert len(token_files.EliasFano.of(np.arange(0, 10**6, 600)).to_bytes()) * 8 / 1667 < 16


def test_token_files(docs, empty):
    t = WordEncoder(WORD, False)
    got = {r.doc_id: r for r in token_files.token_file_digest(docs, WORD).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = t.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_file_digest(empty, WORD).collect() == []


def test_token_files_with_null_and_repeated_ids(spark):
    rows = [(None, "a"), (3, "b"), (3, "c d"), (None, "e f g"), (-5, "h")]
    got = token_files.token_file_digest(spark.createDataFrame(rows, "doc_id long, text string"), WORD).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -5, 3, 3]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


def test_ranges_of_hot_doc_ids(spark, monkeypatch):
    """Nulls and one doc_id hold most rows: they are spread over ranges, and the files still ascend."""
    monkeypatch.setattr(token_files, "RANGE_BYTES", 40)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"w{i} x", i) for i in range(90)] + [(None, None, 1)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, bucket long")
    runs = token_files.write_token_files(d, WORD, token_files.scratch_path(spark, "hot"))
    assert runs.groupBy("bucket").agg(F.sum("n_docs").alias("n")).agg(F.max("n")).first()[0] < 20
    got = token_files.read_token_files(runs).orderBy("start").collect()
    names = [r.doc_id for r in got]
    assert names == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    e = WordEncoder(WORD, False)
    want = Counter((n, e.encode(t) + np.array([2], "<u4").tobytes()) for n, t, _ in rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want


def test_wide_ids_get_four_bytes(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    runs = token_files.write_token_files(d, WORD, token_files.scratch_path(spark, "wide"), end_id=70_000)
    ids = np.frombuffer(token_files.read_token_files(runs).first().ids, "<u4").tolist()
    assert ids == [*WordEncoder(WORD, False).tokenizer.encode("a b").ids, 70_000]


def test_best_fit_plan_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(30):
        size = r.choice([7, 16, 50])
        lengths = sorted((r.randint(1, size) for _ in range(r.randint(1, 200))), reverse=True)
        open_ = []
        for n in lengths:
            fits = [c for c in open_ if c >= n]
            if fits:
                open_[open_.index(min(fits))] -= n
            else:
                open_.append(size - n)
        plan = packing.best_fit_plan(Counter(lengths), size)
        used = Counter()
        for length, _, n, first, _ in plan:
            for w in range(first, first + n):
                used[w] += length
        assert sorted(size - used[w] for w in used) == sorted(open_)


def test_packing(docs, empty):
    e = WordEncoder(BYTE, True)
    rows = packing.pack_documents(docs, BYTE, size=128, keep_ids=True).collect()
    pieces, windows = {}, {}
    for p in rows:
        pieces.setdefault(p.doc_id, []).append(p)
        windows.setdefault(p.sequence_id, []).append(p)
    for r in docs.collect():
        ids = np.frombuffer(e.encode(r.text), "<u4").tolist() + [1]
        own = sorted(pieces[r.doc_id], key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == ids
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(p.ids) for p in own)
    for own in windows.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.concatenate([[0], np.cumsum([p.length for p in own])[:-1]]).tolist()
        assert sum(p.length for p in own) <= 128
    assert sorted(windows) == list(range(len(windows)))
    assert packing.pack_documents(empty, BYTE).collect() == []


def test_packed_sequences(docs):
    packed = packing.pack_documents(docs, BYTE, size=128, keep_ids=True)
    seqs = packing.packed_sequences(packed, 0, 128).collect()
    assert all(len(s.ids) == 512 for s in seqs)
    assert sum(s.used for s in seqs) == packed.agg(F.sum("length")).first()[0]


def test_token_counts(docs, empty):
    e = WordEncoder(BYTE, True)
    lengths = sorted(len(e.encode(r.text)) // 4 for r in docs.collect())
    totals = token_counts.length_totals(token_counts.length_histogram(docs, BYTE))
    rows = totals.collect()
    assert sorted(r.length for r in rows) == sorted(set(lengths))
    for r in rows:
        assert r.n_docs == lengths.count(r.length)
        assert r.docs_longer == sum(x > r.length for x in lengths)
        assert r.tokens == sum(x for x in lengths if x <= r.length)
        assert r.tokens_truncated == sum(min(x, r.length) for x in lengths)
    for r in token_counts.truncated_total(totals, [0, 5, 77, 10**6]).collect():
        assert r.tokens == sum(min(x, r.context) for x in lengths)
    for r in token_counts.length_quantiles(totals, [0.25, 0.5, 1.0]).collect():
        assert r.length == lengths[-(-int(r.share * len(lengths) * 1000) // 1000) - 1] or abs(r.share * len(lengths) % 1) > 0
    assert token_counts.length_totals(token_counts.length_histogram(empty, BYTE)).collect() == []


def brute_hits(words, items, window=10):
    hit, names = set(), set()
    for name, w in items:
        n = min(window, len(w))
        for at in range(len(w) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[at : at + n]:
                    hit.update(range(i, i + n))
                    names.add(str(name))
    return len(hit), sorted(names)


@pytest.mark.parametrize("index_bytes", [2 << 20, 400])
def test_decontamination(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(decontamination, "INDEX_BYTES", index_bytes)
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abcdefgh") + str(r.randint(0, 3)) for _ in range(r.choice([1, 2, 4, 10, 15])))) for i in range(12)] + [(90, None), (91, ""), (92, "!!")]
    texts = random_texts()[:20] + ODD
    for k, (_, t) in enumerate(items):
        texts.append(f"some words {(t or '').upper()}, and {t} more" if k % 2 else f"{t}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = [(n, decontamination.alnum_words((t or "").encode())) for n, t in items]
    got = {x.doc_id: x for x in decontamination.benchmark_hits(docs, bench, spans=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = decontamination.alnum_words((t or "").encode())
        n_hit, names = brute_hits(w, words)
        g = got[i]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (len(w), n_hit, len(names), n_hit > 0), t
        assert g.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert {x for s in g.spans for x in range(s.begin, s.end)} == set() or n_hit
    kept = decontamination.drop_contaminated(docs, bench)
    assert {x.doc_id for x in kept.collect()} == {i for i in got if not got[i].contaminated}
    assert decontamination.benchmark_hits(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.benchmark_hits(docs.limit(0), bench).collect() == []


@pytest.mark.parametrize("index_bytes", [2 << 20, 40])
def test_items_without_an_id_name_nothing(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(decontamination, "INDEX_BYTES", index_bytes)
    items = spark.createDataFrame([(None, "one two three"), (7, "four five six"), (None, None)], "item_id long, text string")
    d = spark.createDataFrame([(1, "zero one two three end"), (2, "four five six one two three"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.benchmark_hits(d, items).collect()}
    none, seven = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"7").hexdigest()
    assert got == {1: (5, 3, 0, none, True), 2: (6, 6, 1, seven, True), 3: (0, 0, 0, none, False)}


def test_contaminated_rows_are_judged_by_their_own_texts(spark, monkeypatch):
    hit, long = "one two three four five six seven eight nine ten", "word " * 200_000
    rows = [(None, hit), (None, "clean"), (1, hit), (1, "clean"), (2, "x"), (3, None), (4, ""), (5, long), (6, long + hit), (7, hit), (7, hit)]
    d = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    items = spark.createDataFrame([(1, hit + " eleven"), (2, "qq ww ee rr tt yy uu ii oo pp aa")], "item_id long, text string")
    for size in (2 << 20, 30):
        monkeypatch.setattr(decontamination, "INDEX_BYTES", size)
        got = [(r.doc_id, r.n_words, r.n_hit) for r in decontamination.benchmark_hits(d, items).collect()]
        assert Counter(got) == Counter((i, len((t or "").split()), 10 if t and hit in t else 0) for i, t in rows)
        kept = decontamination.drop_contaminated(d, items)
        assert kept.columns == d.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r for r in rows if hit not in (r[1] or ""))


def brute_components(texts, percent, n):
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_texts():
    """Random texts and chains of edits of four of them."""
    r = random.Random(9)
    texts = random_texts()
    for w in [[f"v{r.randint(0, 400)}" for _ in range(n)] for n in (30, 60, 90, 200)]:
        for _ in range(12):
            w = list(w)
            w[r.randrange(len(w))] = f"z{r.randint(0, 50)}"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("percent", "shingle", "part"), [(90, 3, 32), (80, 5, 2)])
def test_jaccard_components(spark, monkeypatch, percent, shingle, part):
    """With tiny parts most links are found by the queries against groups."""
    monkeypatch.setattr(ngram_join, "PART", part)
    rows = list(enumerate(near_texts()))
    random.Random(1).shuffle(rows)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent, shingle).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(rows, percent, shingle)


def test_groups_are_opened_only_within_their_bound(spark):
    """Every link between components qualifies, and most groups that share a token with a query are rejected."""
    r = random.Random(3)
    base = [f"b{i}" for i in range(60)]  # a passage that many texts share
    texts = [" ".join(base[k : k + 40] + [f"u{i}x{j}" for j in range(r.randint(5, 60))]) for i, k in enumerate(r.randint(0, 20) for _ in range(80))]
    texts += [t + f" more{i}" for i, t in enumerate(texts[:20])]
    sets = ngram_join.shingle_sets(pa.array(texts), 3)
    rows = []
    for i, s in enumerate(sets):
        prefix = s.tolist()[: int(ngram_join.prefix_length(np.array([len(s)]), 90)[0])]
        rows.append((i, len(s), [x - (1 << 63) for x in prefix]))
    d = spark.createDataFrame(rows, "node long, n_shingles long, prefix array<long>")
    none = spark.createDataFrame([], "node long, head long")
    pairs, groups = ngram_join.qualifying(d, none, 90, ngram_join.Scratch(spark))
    group = {x.node: x.group for x in groups.collect()}
    pairs = {(x.node, x.group) for x in pairs.collect()}
    assert max(Counter(group.values()).values()) > 2  # crowds share the passage's tokens
    both = ngram_join.overlaps(sets, sets)
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * both[i, j] >= 90 * (len(sets[i]) + len(sets[j]) - both[i, j])}
    of = lambda i: group.get(i, i)
    assert len(links) >= 10 and all((i, of(j)) in pairs or (j, of(i)) in pairs for i, j in links)
    tokens = {}
    for i in range(len(rows)):
        tokens.setdefault(of(i), set()).update(rows[i][2])
    meet = {(i, g) for i in range(len(rows)) for g, t in tokens.items() if t & set(rows[i][2]) and t != set(rows[i][2])}
    assert pairs <= meet and len(pairs) < len(meet) / 2  # the bound rejects most groups that share a token


@pytest.mark.parametrize("percent", [80, 90])
def test_the_bound_holds_for_every_size_in_a_group(spark, percent):
    """least_need isn't above what any size between the least and the largest needs."""
    r = random.Random(percent)
    rows = [(n, low, r.randint(low, n * 100 // percent)) for n in range(1, 300) for low in r.choices(range(-(-n * percent // 100), n * 100 // percent + 1), k=4)]
    d = spark.createDataFrame(rows, "n long, low long, high long")
    bound = ngram_join.least_need(F.col("n"), F.col("low"), F.col("high"), percent)
    each = d.withColumn("bound", bound).withColumn("m", F.explode(F.sequence("low", "high")))
    least = each.groupBy("n", "low", "high").agg(F.min("bound").alias("bound"), F.min(ngram_join.need(F.col("n"), F.col("m"), percent)).alias("least"))
    assert least.where("bound > least").count() == 0
    assert least.where("bound < least - 1").count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_no_link_is_lost_at_the_bound(spark, percent):
    """Sets of four texts where one links with a single member of a group, with exactly the least similarity."""
    r, texts = random.Random(percent), []
    for k in range(150):
        # of 3-word shingles y has n + ends, x shares n of them and has one of its own: n / (n + ends + 1) = percent / 100
        ends = r.choice([2, 3, 4, 5, 6]) if percent == 90 else r.choice([1, 3, 5, 7])
        n = (ends + 1) * percent // (100 - percent)
        y = [f"q{k}w{j}" for j in range(n + ends + 2)]
        texts += [y, y[ends:] + [f"new{k}"], y[:-ends], [f"ahead{k}", *y]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(texts[1])), (5000, " ".join(texts[1])), (5001, None)]
    found = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert all(found[i] == i // 4 * 4 for i in range(len(texts))) and found[5000] == 0 and found[5001] == 5001


def test_spanning_links_connect_what_the_found_ones_do():
    r = np.random.default_rng(2)
    for _ in range(20):
        found, left, right = r.random((9, 7)) < 0.15, r.permutation(30)[:9].tolist(), r.permutation(30)[:7].tolist()
        every = [(left[i], right[j]) for i, j in zip(*np.nonzero(found), strict=True)]

        def parts(edges):
            root = {x: x for x in range(30)}
            for _ in range(30):
                for x, y in edges:
                    root[x] = root[y] = min(root[x], root[y])
            return root

        few = ngram_join.spanning(found, left, right)
        assert set(few) <= set(every) and parts(few) == parts(every) and len(few) <= 15


def test_jaccard_edges(spark, empty):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "A B  C D"), (3, None), (4, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("node", F.lit(2)).withColumn("__hash", F.lit(3))
    got = sorted(((x.doc_id, x.component_id) for x in ngram_join.jaccard_components(d).collect()), key=str)
    assert got == sorted([(None, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4)], key=str)
    assert sorted(x.doc_id for x in ngram_join.drop_near_copies(d).collect()) == [1, 3, 4]
    assert ngram_join.jaccard_components(empty).collect() == []


def test_rows_link_by_their_own_texts(spark):
    """A doc_id with two texts links through both; a text without a doc_id is a link of a chain."""
    w = [f"k{i}" for i in range(60)]
    chain = [" ".join(w), " ".join([*w[:59], "x"]), " ".join([*w[:58], "y", "x"])]
    rows = [(5, "something else entirely " * 3), (5, chain[0]), (9, chain[1]), (None, chain[2]), (7, " ".join([*w[:57], "q", "y", "x"])), (8, "another text of its own")]
    got = sorted((x.doc_id or -1, x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 90, 3).collect())
    assert [g[2] for g in got if g[1] == 58] == [5, 5, 5, 5] and [g[2] for g in got if g[0] == 8] == [8]
    kept = ngram_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 90, 3).collect()
    assert sorted((x.doc_id, x.text == chain[0]) for x in kept) == [(5, False), (5, True), (8, False)]


def test_sharding(docs, empty, spark):
    rows = sharding.shard_documents(docs, 5).collect()
    size = {r.doc_id: len((r.text or "").encode()) + 1 for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == size
    assert all(r.text_crc32 == zlib.crc32((t or "").encode()) for r in rows for t in [dict(docs.select("doc_id", "text").collect())[r.doc_id]] if r.doc_id < 5)
    for s in range(5):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - sum(size.values()) / 5) <= max(size.values())
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same").alias("text"))
    n = Counter(r.shard for r in sharding.shard_documents(hot, 4).collect())
    assert max(n.values()) - min(n.values()) <= 1
    assert sharding.shard_documents(empty).collect() == []


def test_shards_hold_every_row_once(spark):
    rows = [(1, "a", 5), (1, "b", 6), (None, "c", 7), (None, None, 8), (2, "d" * 100_000, 9), (3, "", 1), (3, "", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, slot long")
    path = token_files.scratch_path(spark, "out")
    sharding.write_shards(d, path, 3)
    got = spark.read.parquet(path).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def py_luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pseudonyms(spark):
    texts = [
        "card 4737097684299439 and 4737-0976-8429-9439, not 2123465659789240",
        "call +1 (743) 555-3824 or 743-555-3824",
        "ip 97.51.17.173, again 97.51.17.173. not 300.1.1.1 or 1.2.3.4.5",
        "mail that.92@mail2.example.com!",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x',
        "born 1984-02-29, 1983-02-29, 31.12.1999",
        "ssn 123-45-6789 not 666-45-6789",
        "iban GB82 WEST 1234 5698 7654 32 not GB83 WEST 1234 5698 7654 32",
        "Licensed under CC BY-NC 4.0. clean, 12 monkeys in 2020",
        None,
        "",
        "x" * 100_000 + " 1",
    ]
    d = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_replaced int")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymize(d, "k").collect()}
    t = {i: r.text for i, r in rows.items()}
    a, b, c = (x.strip(",") for x in (t[0].split()[1], t[0].split()[3], t[0].split()[5]))
    assert c == "2123465659789240" and a != "4737097684299439" and a == b.replace("-", "") and py_luhn(a) and len(b) == 19
    assert t[1].startswith("call +1 (") and "3824" not in t[1] and len(t[1]) == len(texts[1])
    ips = [w.strip(",.") for w in t[2].split()]
    assert ips[1] == ips[3] != "97.51.17.173" and ips[5] == "300.1.1.1" and ips[7] == "1.2.3.4.5"
    assert "that.92" not in t[3] and t[3].endswith("@mail.invalid!")
    assert len(t[4]) == len(texts[4]) and "24be64" not in t[4] and t[4].startswith('token = "')
    assert "1984-02-29" not in t[5] and "1983-02-29" in t[5] and "31.12.1999" not in t[5]
    assert "123-45-6789" not in t[6] and "666-45-6789" in t[6]
    assert "GB82" not in t[7] and "GB83 WEST 1234 5698 7654 32" in t[7] and "WEST" in t[7].split(" not ")[0]
    assert t[8] == texts[8] and rows[8].n_replaced == 0 and t[9] is None and t[10] == "" and t[11] == texts[11]
    assert rows[0].n_replaced == 2


def test_cards_and_ibans_among_other_groups(spark):
    card, iban, short, swiss = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "CH93 0076 2011 6238 5295 7"
    texts = [
        card,
        f"{card} 12/25",
        f"{card} 123",
        f"no 12 {card}",
        f"99 88 77 {card} 12 {card}-7 end",
        f"{card} 123-45-6789",
        f"{card} 2027-12-31",
        f"{card} 743-555-3824",
        iban,
        f"{iban} BIC",
        f"{iban} BANK OF A",
        f"{iban} {card} 123",
        f"AT12 {iban} NOW",
        f"{iban} MAIL JOE@X.COM",
        short,
        f"{short} AND",
        f"{short} {iban} {short}",
        f"{short} PASSWORD=abcdefgh12345678",
        swiss,
        f"{swiss} 1234",
        "4111 1111 1111 1112 123 and AT61 1904 3002 3457 3202 BIC",
        "in 1999 2000 2001 2002 2003 2004 2005",
        f"{card} 5",  # 17 digits
        f"{card} 011",  # 19 digits that are a valid number too
    ]
    assert py_luhn("4111111111111111011")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_replaced) for r in pseudonyms.pseudonymize(d, "k").collect()}
    new = {texts[i]: got[i][0] for i in (0, 8, 14, 18)}
    assert all(a != b and len(a) == len(b) for a, b in new.items()) and py_luhn(new[card].replace(" ", ""))
    for i, t in enumerate(texts):
        want, n = t, 0
        for old in new:
            want, n = want.replace(old, new[old]), n + t.count(old)
        if i in (5, 6, 7, 13, 17):  # what follows is personal as well
            assert got[i][1] == n + 1 and got[i][0].startswith(want[: len(card) if i < 8 else len(iban) if i == 13 else len(short)]) and got[i][0] != want
        else:
            assert got[i] == (want, n), t


def test_phone_numbers_are_linked_across_spellings(spark):
    spellings = ["+49 30 12345678", "+493012345678", "+49-30-1234-5678", "+49 (0)30 12345678", "+1 (743) 555-3824", "743-555-3824", "(743) 555-3824", "+17435553824", "+351 912 345 678", "+351912345678"]
    d = spark.createDataFrame([(i, f"call {t}") for i, t in enumerate(spellings)] + [(90, f"{spellings[0]}, {spellings[1]}")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymize(d, "k").collect()}
    digits = ["".join(c for c in got[i] if c.isdigit()) for i in range(len(spellings))]
    assert digits[0] == digits[1] == digits[2] == digits[3].replace("490", "49", 1) and digits[0].startswith("49") and digits[0] != "493012345678"
    assert digits[4] == digits[7] == "1" + digits[5] and digits[5] == digits[6] != "7435553824" and digits[8] == digits[9]
    assert all(len(got[i]) == len(f"call {t}") for i, t in enumerate(spellings))
    assert "".join(c for c in got[90] if c.isdigit()) == 2 * digits[0]


def test_secrets_are_replaced_to_their_end(spark):
    long, dotted = "a1B2c3D4e5" * 30, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3.Sfl-KxwRJS_M"
    values = [long, dotted, "YWJjZGVmZ2hpamtsbW5vcDEyMw==", "x" * 250 + "7", "key=abcdefgh1234.z9"]
    texts = [f'token = "{v}". Next' for v in values] + [f"password={v}. Next" for v in values] + ["token=short.1234. Next"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pseudonyms.pseudonymize(d, "k").collect():
        t = texts[r.doc_id]
        if r.doc_id == 2 * len(values):
            assert r.text == t and r.n_replaced == 0
            continue
        value = values[r.doc_id % len(values)]
        at = t.index(value)
        new = r.text[at : at + len(value)]
        assert r.n_replaced == 1 and r.text == t.replace(value, new) and set(new) <= set("0123456789abcdef"), t


def test_feistel_is_a_permutation_and_keyed(spark):
    d = spark.range(17 * 43).select((F.col("id") / 43).cast("long").alias("a"), (F.col("id") % 43).alias("b"))
    out = lambda key: [tuple(r[0]) for r in d.select(pseudonyms.feistel(F.col("a"), F.col("b"), F.lit(17), F.lit(43), key, "t")).collect()]
    one = out("k")
    assert sorted(one) == sorted((x, y) for x in range(17) for y in range(43)) and one != out("other") and one == out("k")
    digits = spark.range(1000).select(pseudonyms.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("x"))
    assert len({r.x for r in digits.collect()}) == 1000 and all(len(r.x) == 3 for r in digits.collect())


def py_metrics(t):
    w = [x for x in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(win)
    rep = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep)


def test_quality_rules(spark, empty):
    r = random.Random(2)
    line = " ".join(f"word{i}" for i in range(12))
    texts = random_texts() + [f"{line}\n" * 6, line + " x " + line, "abc " * 60, "!!! " * 30, "the *** $$$ " * 20, " ".join(f"good{i}" for i in range(50)), "same same " * 15 + " ".join(f"u{r.random()}" for _ in range(5))]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {x.doc_id: x for x in quality_rules.quality_verdicts(d).collect()}
    for i, t in enumerate(texts):
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == py_metrics(t), t
        assert g.base_failed == (g.n_words < 20 or g.n_repeat_words * 100 > g.n_words * 30) and not (g.base_failed and g.kept)
    kept = quality_rules.keep_good(d)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {i for i in got if got[i].kept}
    assert quality_rules.quality_verdicts(empty).collect() == [] and quality_rules.keep_good(empty).collect() == []


def test_cascade_order_by_rejection_per_cost(spark):
    d = spark.createDataFrame([(i, "a " * (i % 50 + 1)) for i in range(400)], "doc_id long, text string")
    rules = [quality_rules.Rule("never", lambda t, w: F.lit(False)), quality_rules.Rule("often", lambda t, w: F.size(w) < 40)]
    assert [r.name for r in quality_rules.estimate_order(d, rules)] == ["often", "never"]


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic, good = i % 8 == 0, i % 3 != 0
        words = [r.choice("lorem ipsum dolor sit amet tempus ornare vitae".split()) + str(r.randint(0, 20)) for _ in range(r.randint(20, 150))]
        if toxic:
            words[r.randrange(len(words))] = r.choice(["idiot", "Scum!", "grumbledorf"])
        if not good:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "lorem")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("label", "score", "folds", "held"), [("toxic", toxicity.toxicity_scores, 5, 0), ("quality", quality_model.quality_scores, 3, 1)])
def test_classifiers_on_held_out_rows(labelled, label, score, folds, held):
    docs, labels = labelled
    truth = {r.doc_id: r[label] for r in labels.where(F.col(label).isNotNull()).collect()}
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == held)
    own = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in own) / len(own) >= 0.9
    assert len(score(docs, labels.limit(0)).collect()) == docs.count()
    assert score(docs.limit(0), labels).collect() == []


def test_scores_do_not_depend_on_the_batch():
    r = np.random.default_rng(5)
    bags = [r.random((k, quality_model.FEATURES)).astype(np.float32) for k in (1, 5, 16, 17, 40, 1, 200)]
    m = quality_model.AttentionModel(1)
    whole, alone = m.scores(bags), [m.scores([b])[0] for b in bags]
    assert whole.tolist() == alone and m.scores(bags[::-1])[::-1].tolist() == alone and len(m.scores([])) == 0
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    assert np.abs(whole - m._forward(np.concatenate(bags), starts)["y"]).max() < 1e-5


def test_attention_model_gradients():
    r = np.random.default_rng(1)
    m = quality_model.AttentionModel()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, starts, y = r.standard_normal((7, quality_model.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = m._forward(x, starts)["y"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = m._gradients(m._forward(x, starts), y, starts)
    for k in m.p:
        flat = m.p[k].reshape(-1)
        for i in (0, len(flat) // 2):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - g[k].reshape(-1)[i]) < 1e-4, k


HARD = [(None, None), (None, "some text"), (1, None), (1, ""), (2, "same text twice"), (2, "same text twice"), (3, "long " * 60_000), (4, "x" * 150_000), (5, " \n\t "), (6, "ok ok ok. fine?")]
OPERATORS = {
    "toxicity": lambda d, lab, bench: toxicity.toxicity_scores(d, lab),
    "pseudonyms": lambda d, lab, bench: pseudonyms.pseudonymize(d, "k"),
    "decontamination": lambda d, lab, bench: decontamination.benchmark_hits(d, bench),
    "token_files": lambda d, lab, bench: token_files.token_file_digest(d, WORD),
    "quality_model": lambda d, lab, bench: quality_model.quality_scores(d, lab),
    "ngram_join": lambda d, lab, bench: ngram_join.jaccard_components(d),
    "quality_rules": lambda d, lab, bench: quality_rules.quality_verdicts(d),
    "sharding": lambda d, lab, bench: sharding.shard_documents(d, 3),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_nulls_repeats_long_texts_and_clashing_columns(spark, name):
    """One row comes back for each row, and rows of one text get the same of what doesn't number them."""
    clashing = ["node", "key", "part", "row", "size", "bucket", "score", "rank", "token", "__words", "n_words", "component", "slot", "y", "ids"]
    d = spark.createDataFrame(HARD, "doc_id long, text string").select("*", *[F.lit("c").alias(c) for c in clashing]).repartition(2)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "same text twice"), (None, None), (3, "")], "item_id long, text string")
    rows = OPERATORS[name](d, labels, bench).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in HARD)
    numbers = {"start", "slot", "shard"}
    two = [{k: v for k, v in r.asDict().items() if k not in numbers} for r in rows if r.doc_id == 2]
    assert two[0] == two[1]
    if name == "quality_model":
        assert all(r.score == 0.5 for r in OPERATORS[name](d, labels.limit(0), bench).collect())


def test_packing_and_counts_of_hard_rows(spark):
    d = spark.createDataFrame(HARD, "doc_id long, text string").select("*", F.lit(1).alias("length"), F.lit("p").alias("part"), F.lit("r").alias("rank"))
    e = WordEncoder(BYTE, True)
    want = Counter()
    for i, t in HARD:
        want[i] += len(e.encode(t)) // 4 + 1
    got = packing.pack_documents(d, BYTE).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == dict(want)
    total = token_counts.length_totals(token_counts.length_histogram(d, BYTE)).agg(F.max("tokens")).first()[0]
    assert total == sum(want.values()) - len(HARD)

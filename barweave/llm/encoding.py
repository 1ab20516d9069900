"""Whole-text encoding with the public tokenizers, one white-space-delimited word at a time.

Both vocabularies cut a text at white space before they merge anything, so the ids of a text are the ids of its words
and of the white space between them, one after another.  A slab of texts is cut into words over its bytes at once; each
distinct word is looked up in a bounded memo, a mark at its end apart, the library encodes what the memo lacks, and the
ids are gathered.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shingles import EXACT, codes_of, powers, slabs, span_sums, word_spans

#: Words that the memo holds, and the longest one in bytes: some tens of MB in each Python worker, twice that while
#: words are added.
MEMO_WORDS, MEMO_BYTES = 500_000, 40
#: Bytes of Arrow batches that are joined, and of a slab of texts: arrays over its words take some 80 times as much.
JOINED = 1 << 20
MARKS = b".,!?;:"
# White space beyond ASCII's, which words of bytes don't end at: such texts are encoded whole.
_WIDE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LATIN = np.zeros(256, bool)  # second bytes of the letters from U+00C0 to U+00FF
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LED = np.uint64(0xA24BAED4963EE407)


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Byte-level vocabularies write the bytes that don't print as the characters from U+0100 on.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTS)}


def rebatched(batches: Iterator[pa.RecordBatch], size: int = JOINED) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``size`` bytes."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def eight(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place on as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at]
    keep = np.minimum(length, 8).astype(np.uint64) * np.uint64(8)
    return np.where(keep == 64, words, words & ((np.uint64(1) << (keep % np.uint64(64))) - np.uint64(1)))


class Pool:
    """Runs of ids in one growing array; a run is (begin, length)."""

    def __init__(self):
        self.ids, self.n = np.zeros(1 << 16, np.uint32), 0

    def add(self, ids: list[int] | np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        new, length = np.array(ids, np.uint32), np.array(lengths, np.int64)
        if self.n + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n], np.zeros(self.n + 2 * len(new), np.uint32)])
        self.ids[self.n : self.n + len(new)] = new
        begin = self.n + np.cumsum(length) - length
        self.n += len(new)
        return begin, length


def gather(ids: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs one after another, and where each begins (and the last one ends)."""
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
    return ids[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])], ends


class WordEncoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    ``blanks``: the vocabulary joins a blank to the word after it (byte-level BPE), so a word is looked up with or
    without one, and other white space has ids of its own; else white space is dropped and letters are lowered.  Memo
    entries are found by a word's code and told apart by its first and last eight bytes as well.  A full memo keeps
    the words that were met again.
    """

    def __init__(self, path: str, blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.blanks = blanks
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_WIDE, *added])
        self._clear()

    def _clear(self) -> None:
        self.pool = Pool()
        fixed = [[], self._ids("\n") if self.blanks else [], *(self._ids(chr(m)) for m in MARKS)]
        self.fixed = self.pool.add([x for ids in fixed for x in ids], [len(ids) for ids in fixed])
        self.gaps: dict[bytes, tuple[int, int]] = {}
        # code, first and last bytes, begin and length of the run, whether the word was met again
        self.memo = [np.zeros(0, np.uint64)] * 3 + [np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool)]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str], led: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of distinct words into the pool.  A run of Latin letters goes to the model alone, as normalizing
        and cutting leave it whole; the library encodes the others."""
        ids, lengths, others, tokenize, blanks, blank = [], [], [], self.tokenize, self.blanks, _BYTE_CHARS[0x20]
        for k, w in enumerate(words):
            if w.isalpha() and (w.isascii() or max(w) <= "\xff"):
                if not blanks:  # A-Z are lowered already
                    w = w.lower()
                if not w.isascii():
                    w = w.encode().decode("latin-1").translate(_BYTE_CHARS)
                tokens = tokenize(blank + w if led[k] else w)
                lengths.append(len(tokens))
                ids += [t.id for t in tokens]
            else:
                others.append(k)
        begin, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        model = np.ones(len(words), bool)
        model[others] = False
        begin[model], length[model] = self.pool.add(ids, lengths)
        if others:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([" " + words[k] if led[k] else words[k] for k in others], add_special_tokens=False)]
            begin[others], length[others] = self.pool.add([x for ids in found for x in ids], [len(ids) for ids in found])
        return begin, length

    def _runs(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, code: np.ndarray, led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pool has the ids of each word."""
        code = code + np.where(led, _LED, np.uint64(0))
        first, last = eight(data, s, e - s), eight(data, np.maximum(s, e - 8), e - s)
        begin, length = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        hit = np.zeros(len(code), bool)
        if len(self.memo[0]):
            known, firsts, lasts, begins, lengths, again = self.memo
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = (known[at] == code) & (firsts[at] == first) & (lasts[at] == last)
            at = at[hit]
            begin[hit], length[hit], again[at] = begins[at], lengths[at], True
        miss = np.flatnonzero(~hit)
        while len(miss):  # once, but for words of one code, which only a broken hash would give
            _, one, which = np.unique(code[miss], return_index=True, return_inverse=True)
            rows = miss[one]
            cut = [data[a:b].tobytes().decode() for a, b in zip(s[rows].tolist(), e[rows].tolist(), strict=True)]
            b, n = self._learn(cut, led[rows].tolist())
            same = (first[miss] == first[rows][which]) & (last[miss] == last[rows][which])
            begin[miss[same]], length[miss[same]] = b[which[same]], n[which[same]]
            keep = (e - s)[rows] <= MEMO_BYTES
            new = [x[keep] for x in (code[rows], first[rows], last[rows], b, n, np.zeros(len(rows), bool))]
            joined = [np.concatenate([x, y]) for x, y in zip(self.memo, new, strict=True)]
            order = np.argsort(joined[0], kind="stable")
            self.memo = [x[order] for x in joined]
            miss = miss[~same]
        return begin, length

    def _trim(self) -> None:
        """A full memo keeps the words that were met again, if they leave room; other runs go with it."""
        memo, old = self.memo, self.pool.ids
        if len(memo[0]) <= MEMO_WORDS and self.pool.n <= 8 * MEMO_WORDS:
            return
        own = memo[5]
        self._clear()
        if own.sum() <= MEMO_WORDS // 2:
            ids, _ = gather(old, memo[3][own], memo[4][own])
            begin, length = self.pool.add(ids, memo[4][own])
            self.memo = [*(x[own] for x in memo[:3]), begin, length, np.zeros(len(begin), bool)]

    def _gap_runs(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[list[int], list[int]]:
        out = []
        for a, b in zip(s.tolist(), e.tolist(), strict=True):
            gap = data[a:b].tobytes()
            run = self.gaps.get(gap) if len(gap) <= MEMO_BYTES else None
            if run is None:
                ids = self._ids(gap.decode())
                begin, length = self.pool.add(ids, [len(ids)])
                run = int(begin[0]), int(length[0])
                if len(gap) <= MEMO_BYTES:
                    self.gaps[gap] = run
            out.append(run)
        return [r[0] for r in out], [r[1] for r in out]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; none for an empty text or null."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string column."""
        out = [x for data, offsets in slabs(texts, JOINED) for x in self._slab(data, offsets)]
        for i in np.flatnonzero(pc.match_substring_regex(texts, self.whole).fill_null(False).to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self._ids(texts[i].as_py()), np.uint32).tobytes()
        return out

    def _slab(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        data = data if self.blanks else _LOWER[data]
        s, e = word_spans(data, offsets)
        place, kind, begin, length = s, np.zeros(len(s), np.int64), [], []
        if self.blanks:
            # kind 0: no white space before the word, or what has ids of its own; 1: a blank; 2: a line's end
            before = np.zeros(len(s), np.int64)
            before[1:] = e[:-1]
            heads = np.searchsorted(s, offsets[:-1])
            some = heads < np.searchsorted(s, offsets[1:])
            before[heads[some]] = offsets[:-1][some]
            gap, ahead = s - before, data[np.maximum(s - 1, 0)] if len(data) else np.zeros(0, np.uint8)
            kind = np.where(gap == 0, 0, np.where(ahead == 0x20, 1, np.where((gap == 1) & (ahead == 0x0A), 2, 0)))
            odd = np.flatnonzero((gap > 1) | ((gap == 1) & (kind == 0)))
            lone = odd[kind[odd] == 0]  # the last character of the gap stands alone
            last = np.where(some, e[np.maximum(np.searchsorted(s, offsets[1:]) - 1, 0)] if len(e) else 0, offsets[:-1])
            tail = last < offsets[1:]
            extra_s = np.concatenate([before[odd], s[lone] - 1, last[tail]])
            extra_e = np.concatenate([s[odd] - 1, s[lone], offsets[1:][tail]])
            solid = extra_e > extra_s
            extra_s, extra_e = extra_s[solid], extra_e[solid]
            begin, length = self._gap_runs(data, extra_s, extra_e)
            place = np.concatenate([s, extra_s])
        each, run = self._distinct(data, s, e, kind)
        begin = np.concatenate([run[0][each], np.array(begin, np.int64)])
        length = np.concatenate([run[1][each], np.array(length, np.int64)])
        ids = run[2]
        if len(place) > len(s):  # white space with ids of its own takes its place among the words
            shift = len(ids)
            ids = np.concatenate([ids, self.pool.ids[: self.pool.n]])
            begin[len(s) :] += shift
            order = np.argsort(place, kind="stable")
            place, begin, length = place[order], begin[order], length[order]
        whole, ends = gather(ids, begin, length)
        at = (4 * ends[np.searchsorted(place, offsets)]).tolist()
        whole = whole.tobytes()
        self._trim()
        return [whole[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]

    def _distinct(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Which distinct word each word is, and (begin, length, ids) of the distinct ones."""
        sums, n = span_sums(data, s, e, EXACT), e - s
        key = pa.array(codes_of(sums, n) + kind.astype(np.uint64) * _LED).dictionary_encode()
        each = key.indices.to_numpy().astype(np.int64)
        one = np.zeros(len(key.dictionary), np.int64)
        one[each[::-1]] = np.arange(len(s))[::-1]
        s, e, n, kind, sums = s[one], e[one], n[one], kind[one], sums[one]
        mark = np.zeros(len(s), np.int64)
        if len(s):
            good = _LETTER[data]
            latin = (data[:-1] == 0xC3) & _LATIN[data[1:]]
            good[:-1] |= latin
            good[1:] |= latin
            bad = np.concatenate([np.zeros(1, np.int32), np.cumsum(~good, dtype=np.int32)])
            of = np.zeros(256, np.int64)
            of[list(MARKS)] = 2 + np.arange(len(MARKS))
            mark = np.where((n > 1) & (bad[e - 1] == bad[s]), of[data[e - 1]], 0)
            cut = np.flatnonzero(mark)
            power = powers(16)[0] if not len(cut) or n[cut].max() <= 1 << 16 else powers(int(n[cut].max()).bit_length())[0]
            sums[cut] -= EXACT[data[e[cut] - 1]] * power[n[cut] - 1]
            e[cut] -= 1
        begin, length = self._runs(data, s, e, codes_of(sums, e - s), (kind == 1) & self.blanks)
        pieces = [np.stack(x, axis=1).reshape(-1) for x in ((self.fixed[0][kind // 2], begin, self.fixed[0][mark]), (self.fixed[1][kind // 2], length, self.fixed[1][mark]))]
        ids, ends = gather(self.pool.ids, *pieces)
        return each, (ends[:-1:3], ends[3::3] - ends[:-1:3], ids)


@functools.cache
def encoder(path: str, blanks: bool) -> WordEncoder:
    """One encoder for each Python worker, so that its memo outlives a task."""
    return WordEncoder(path, blanks)

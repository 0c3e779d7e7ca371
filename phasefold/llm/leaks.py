"""Evaluation texts leaking into training text.

All held-out passages, as normalised words, go into one generalised suffix
automaton. A document's words are streamed through it; at each word the automaton
knows the longest run of words ending there that any passage holds. From its
states the maximal runs that a document shares with each passage are read off and
chained into spans that may skip a few words on either side, so misspelled,
swapped or added words don't end a span. Between and beside the runs single words
are aligned as well. A span counts if it reaches the least length and most of its
words are aligned. Spans can be removed: words carry their places in the decoded
text, so what is cut out is exactly the span.

The automaton is built in the driver and broadcast. Its size follows the held-out
material only (about 700 bytes a word); more than ``BATCH_WORDS`` words are
searched in several passes.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mail import parts, strip_markup

BATCH_WORDS = 300_000
RUN = 3  # shortest run of words that tells of a place in a passage

_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[​-‏⁠﻿\xad]")


def words(text: str) -> list[str]:
    """Words without case, accents, marks and hidden characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _HIDDEN.sub("", text))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return _WORD.findall(text.casefold())


def word_places(text: str) -> list[tuple[int, int]]:
    """Where each of ``words(text)`` begins and ends in ``text``, its marks and hidden characters included."""
    if text.isascii():
        return [m.span() for m in _WORD.finditer(text)]
    plain, at = [], []
    for i, c in enumerate(text):
        if _HIDDEN.match(c):
            continue
        kept = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        plain.append(kept)
        at += [i] * len(kept)
    out = []
    for m in _WORD.finditer("".join(plain)):
        end = at[m.end() - 1] + 1
        while end < len(text) and (unicodedata.combining(text[end]) or _HIDDEN.match(text[end])):
            end += 1
        out.append((at[m.start()], end))
    return out


def texts(raw: str | None) -> Iterator[str]:
    """The decoded parts of a mail's body."""
    for p in parts(raw):
        yield strip_markup(p.text) if p.kind == "html" or "</" in p.text else p.text


class Automaton:
    """Suffix automaton of several word sequences; sequences are never matched across their ends."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN):
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.run = run
        self.words = dict(items)
        self.short: dict[str, list[tuple[int, list[str]]]] = defaultdict(list)  # passages of fewer words than a run
        for item, seq in items:
            if len(seq) < run:
                self.short[seq[0]].append((item, seq))
        ends: list[list[tuple[int, int]]] = [[]]
        for item, seq in items:
            last = 0
            for pos, word in enumerate(seq):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)), ends)
                ends[last].append((item, pos))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:  # a suffix ends wherever what it is a suffix of ends
            p = self.link[v]
            if p > 0 and self.length[v] >= run and self.length[p] >= run:
                ends[p] += ends[v]
        # the state of the last `run` words for every state at least as long
        self.base = [0] * len(self.length)
        for v in reversed(order):
            p = self.link[v]
            if self.length[v] >= run:
                self.base[v] = v if self.length[p] < run else self.base[p]
        self.places = {v: sorted(set(ends[v])) for v in set(self.base) if v}

    def _extend(self, last: int, w: int, ends: list) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, w, q, ends)
        cur = self._state(length[last] + 1, {}, ends)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q, ends)
        return cur

    def _split(self, p: int, w: int, q: int, ends: list) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), ends)
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _state(self, length: int, nxt: dict, ends: list) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        ends.append([])
        return len(self.length) - 1

    def stream(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(position, state, length) wherever the longest matching run has ``run`` words or more."""
        nxt, link, length, least = self.next, self.link, self.length, self.run
        out = []
        v = n = 0
        for k, w in enumerate(map(self.ids.get, tokens)):
            if w is None:
                v = n = 0
                continue
            row = nxt[v]
            while w not in row and v:
                v = link[v]
                n = length[v]
                row = nxt[v]
            if w in row:
                v = row[w]
                n += 1
                if n >= least:
                    out.append((k, v, n))
        return out

    def runs(self, tokens: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """By item, the maximal runs (last document word, last passage word, words) that tokens share with it.

        A run is maximal if neither end can be moved outwards.
        """
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        live: dict[tuple[int, int], int] = {}  # (item, passage word) of the runs that end at the last word
        last = -2
        for k, v, n in self.stream(tokens):
            if k != last + 1:
                self._close(out, live, last)
                live = {}
            now = {}
            for item, p in self.places[self.base[v]]:
                now[item, p] = live.pop((item, p - 1), self.run - 1) + 1
            self._close(out, live, last)
            live, last = now, k
        self._close(out, live, last)
        return out

    @staticmethod
    def _close(out: dict, live: dict, k: int) -> None:
        for (item, p), n in live.items():
            out[item].append((k, p, n))


def spans(auto: Automaton, tokens: list[str], least: int = 15, cover: float = 0.8, skip: int = 8) -> list[tuple[int, int, int, int, int]]:
    """(item, first word, words, words of the passage, words covered) of every leaked span in ``tokens``."""
    out = []
    if auto.short:
        for k, w in enumerate(tokens):
            for item, seq in auto.short.get(w, ()):
                if tokens[k : k + len(seq)] == seq:
                    out.append((item, k, len(seq), len(seq), len(seq)))
    for item, at in auto.runs(tokens).items():
        seq = auto.words[item]
        want = min(least, len(seq))
        found = set()
        for chain in _chains(at, auto.run, skip):
            # misspelled and swapped words are aligned, so what isn't counts more than it did beside exact runs
            best = _best_span(_aligned(chain, auto.run, tokens, seq), (1 + 3 * cover) / 4)
            if best and best[3] >= want:
                found.add(best)
        for a, b, covered, length in sorted(found):
            if not any((c, d) != (a, b) and c <= a and b <= d for c, d, *_ in found):
                out.append((item, a, b - a + 1, length, covered))
    return out


def alike(a: str, b: str) -> bool:
    """Whether two words are one misspelling apart: two letters swapped or, in words of four letters or more, one changed, added or dropped."""
    if abs(len(a) - len(b)) > 1 or (min(len(a), len(b)) < 4 and (len(a) != len(b) or sorted(a) != sorted(b))):
        return False
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    m = 0
    while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
        m += 1
    x, y = a[n : len(a) - m], b[n : len(b) - m]
    return max(len(x), len(y)) <= 1 or (len(x) == len(y) == 2 and x == y[::-1])


_ADDED = ((1, 0, 1), (2, 0, 2), (3, 0, 2))  # words passed in the document, in the passage, and matches asked for behind them
_EDITS = ((1, 1, 1), (1, 0, 1), (0, 1, 1), (2, 2, 2), (2, 0, 2), (0, 2, 2), (2, 1, 2), (1, 2, 2), (3, 0, 2), (0, 3, 2))


def _walk(doc: list[str], seq: list[str], i: int, j: int, step: int, i_end: int, j_end: int, edits: tuple) -> list[tuple[int, int]]:
    """Aligned (document word, passage word) from i and j on in the direction of ``step``, up to the ends (exclusive)."""
    out = []
    while (n := (i_end - i) * step) > 0 and (m := (j_end - j) * step) > 0:
        v, w = doc[i], seq[j]
        if v == w or alike(v, w):
            out.append((i, j))
            a = b = 1
        elif n > 1 and m > 1 and v == seq[j + step] and doc[i + step] == w:
            out += [(i, j + step), (i + step, j)]
            a = b = 2
        else:
            for a, b, least in edits:
                if a + least <= n and b + least <= m and doc[i + a * step] == seq[j + b * step] and (least == 1 or doc[i + (a + 1) * step] == seq[j + (b + 1) * step]):
                    break
            else:
                break
        i, j = i + a * step, j + b * step
    return out


def _aligned(chain: list[tuple[int, int]], run: int, doc: list[str], seq: list[str]) -> list[tuple[int, int]]:
    """(document word, passage word) of a chain's runs and of what aligns between and beside them, by passage word.

    Beyond the outermost runs words may be misspelled, swapped or added; another
    word in a word's place ends the passage there, else sentences of like pattern
    would run on by chance.
    """
    k, p = chain[0]
    pairs = _walk(doc, seq, k - run, p - run, -1, -1, -1, _ADDED)
    last_k, last_p = k - run, p - run
    for k, p in chain:
        first = max(0, run - min(k - last_k, p - last_p))  # words of this run that are aligned already
        if first == 0:
            pairs += _walk(doc, seq, last_k + 1, last_p + 1, 1, k - run + 1, p - run + 1, _EDITS)
        pairs += [(k - run + 1 + t, p - run + 1 + t) for t in range(first, run)]
        last_k, last_p = k, p
    pairs += _walk(doc, seq, last_k + 1, last_p + 1, 1, len(doc), len(seq), _ADDED)
    return sorted(pairs, key=lambda x: (x[1], x[0]))


def _chains(runs: list[tuple[int, int, int]], run: int, skip: int) -> list[list[tuple[int, int]]]:
    """Runs strung together while both sides move on by at most ``skip``, as places (document word, passage word)."""
    chains: list[list[tuple[int, int]]] = []
    live: list[list[tuple[int, int]]] = []
    for n, k, p in sorted((k - n, k, p) for k, p, n in runs):
        n = k - n
        places = [(k - t, p - t) for t in range(n - run, -1, -1)]
        k, p = places[0]
        live = [c for c in live if k - c[-1][0] <= skip]
        fit = [c for c in live if 0 < p - c[-1][1] <= skip and k > c[-1][0]]
        if fit:
            max(fit, key=lambda c: (-abs((k - c[-1][0]) - (p - c[-1][1])), len(c))).extend(places)
        else:
            chains.append(places)
            live.append(places)
    return chains


def _best_span(pairs: list[tuple[int, int]], cover: float) -> tuple[int, int, int, int] | None:
    """(first, last word in the document, aligned, passage words) of the longest stretch aligned well enough."""
    best = None
    for i in range(len(pairs)):
        if best and pairs[-1][1] - pairs[i][1] + 1 <= best[3]:
            break
        for j in range(len(pairs) - 1, i - 1, -1):
            length = pairs[j][1] - pairs[i][1] + 1
            if best and length <= best[3]:
                break
            if j - i + 1 >= cover * length:
                at = [k for k, _ in pairs[i : j + 1]]
                best = (min(at), max(at), j - i + 1, length)
                break
    return best


def _batches(items: DataFrame, item_id: str, passage: str) -> list[list[tuple[int, list[str]]]]:
    rows = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(item_id, passage).distinct().toLocalIterator()
    out, size = [[]], 0
    for i, text in rows:
        w = words(text)
        if not w:
            continue
        if size + len(w) > BATCH_WORDS and out[-1]:
            out.append([])
            size = 0
        out[-1].append((i, w))
        size += len(w)
    return [sorted(b) for b in out if b]


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", least: int = 15, cover: float = 0.8) -> DataFrame:
    """(doc_id, item_id, part, first_word, n_words, passage_words, covered): every leaked span.

    ``first_word`` counts in the words of the document's ``part``-th decoded text.
    A passage shorter than ``least`` words must be there whole. Null, empty and
    blank texts and passages match nothing; a passage given twice counts once.
    Documents repeated in ``docs`` are repeated in the result. Columns other than
    the four named are not read. Empty tables give an empty result.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    names = ["doc_id", "item_id", "part", "first_word", "n_words", "passage_words", "covered"]
    schema = "doc_id long, item_id long, part int, first_word int, n_words int, passage_words int, covered int"
    out = None
    for batch in _batches(items, item_id, passage):
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(batch))

        def run(tables: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            auto = shared.value
            for b in tables:
                found: list[tuple] = []
                for i, raw in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    for n, t in enumerate(texts(raw)):
                        found += [(i, s[0], n, *s[1:]) for s in spans(auto, words(t), least, cover)]
                cols = list(zip(*found, strict=True)) if found else [[]] * len(names)
                kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_spans(text: str, cut: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans (first word, words) and what stands between them; the rest as it was."""
    if not cut:
        return text
    at = word_places(text)
    keep, pos = [], 0
    for a, n in sorted(cut):
        start, end = at[a][0], at[a + n - 1][1]
        if start > pos:
            keep.append(text[pos:start])
        pos = max(pos, end)
    return "".join([*keep, text[pos:]])


def remove_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", least: int = 15, cover: float = 0.8) -> DataFrame:
    """(doc_id, text, spans, words): every document's decoded text without its leaked spans.

    The decoded parts stand below each other; ``spans`` and ``words`` count what
    was cut out, overlapping spans of several items each. A null text stays null, an empty
    one gives ''. Repeated rows are kept; other columns are not read.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def split(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            apart = [None if raw is None else [t.encode("utf-8", "replace").decode() for t in texts(raw)] for raw in b.column("text").to_pylist()]
            none = pa.array([0] * b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(apart, pa.list_(pa.string())), none, none], ["doc_id", "parts", "spans", "words"])

    schema = "doc_id long, parts array<string>, spans int, words int"
    out = slim.mapInArrow(split, schema)
    for batch in _batches(items, item_id, passage):
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(batch))

        def run(tables: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            auto = shared.value
            for b in tables:
                left, n_spans, n_words = [], b.column("spans").to_pylist(), b.column("words").to_pylist()
                for i, parts_ in enumerate(b.column("parts").to_pylist()):
                    if parts_ is not None:
                        cuts = [[(s[1], s[2]) for s in spans(auto, words(t), least, cover)] for t in parts_]
                        n_spans[i] += sum(map(len, cuts))
                        n_words[i] += sum(n for c in cuts for _, n in c)
                        parts_ = list(map(without_spans, parts_, cuts))
                    left.append(parts_)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(left, pa.list_(pa.string())), pa.array(n_spans, pa.int32()), pa.array(n_words, pa.int32())], ["doc_id", "parts", "spans", "words"])

        out = out.mapInArrow(run, schema)
    return out.select("doc_id", F.when(F.col("parts").isNotNull(), F.concat_ws("\n\n", "parts")).alias("text"), "spans", "words")

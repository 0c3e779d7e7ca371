"""Byte-level BPE of a whole corpus with Spark higher-order functions.

A text is cut into words by the tokenizer's pattern, once. A word that is a token
itself or a frequent word is looked up; any other becomes the array of its bytes,
over which a fold applies the lowest-ranked merge until none is left. The ranks
sit in a constant rank map (rows of a sparse table laid over each other), so a
lookup is two array reads, nothing is shuffled or broadcast by data size, and a
text costs the same wherever it lies. Decoding joins the tokens' byte strings.

The fold is quadratic in a word's length, so the single words longer than
``LONG`` bytes take the same merges with a heap (``merge_word``) in Arrow batches.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SLOTS = 1 << 17
MEMO_WORDS = 60_000  # words of several tokens that are kept with their ids
MEMO_DOCS = 20_000  # documents whose words compete for the memo
LONG = 256  # bytes of a word

#: A place of a word's array holds (rank << 16 | id): the token's id and the rank, less ``HALF``, of the
#: merge with its right neighbour, ``NEVER`` where they don't merge. The rank of a merge is the merged id.
HALF = 1 << 15
NEVER = 32767 << 16


def _byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        special = {"<|endoftext|>"}
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in special}
        self.pieces = {i: b for b, i in self.ids.items()}
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y = as_bytes(a), as_bytes(b)
            self.pairs.setdefault((self.ids[x], self.ids[y]), (rank, self.ids[x + y]))
        order = sorted(self.pairs.values())
        if any(a[1] >= b[1] for a, b in zip(order, order[1:], strict=False)) or max(self.pieces) >= 2 * HALF - 1:
            raise ValueError("token ids must rise with the rank of their merge and lie below 65,535")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def two_choice(entries: list[tuple[int, int, object]], slots: int) -> tuple[list, list]:
    """Two tables in which each (first slot, second slot, item) lies at one of its slots."""
    tables: tuple[list, list] = ([None] * slots, [None] * slots)
    for e in entries:
        side = 0 if tables[0][e[0]] is None or tables[1][e[1]] is not None else 1
        for _ in range(500):
            at = e[side]
            e, tables[side][at] = tables[side][at], e
            if e is None:
                break
            side = 1 - side
        else:
            raise ValueError("tables too small")
    return tables


def word_slots(word: bytes) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(word, seed=42)
    return h % WORD_SLOTS, (h >> 24) % WORD_SLOTS


def rank_rows(v: Vocabulary) -> tuple[list[int], list[int]]:
    """(first, cells): the merge of left token a and right token b lies in cells[first[a] + b].

    Rows of the sparse table of merges are laid over each other, the fullest
    first, each at the first shift that meets only free cells. A cell holds its
    entry in the form of a word's array; a foreign one tells by its lower half.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), (_, m) in v.pairs.items():
        rows.setdefault(a, []).append((b, m))
    free = np.ones(8 * 2 * HALF, dtype=bool)
    cells = np.full(len(free), NEVER, dtype=np.int64)
    first = [0] * (max(v.pieces) + 1)
    open_cells, used = np.arange(len(free) - 2 * HALF), 0
    for a, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        cols = np.array(sorted(b for b, _ in row))
        for z in range(0, len(open_cells), 2048):
            shifts = open_cells[z : z + 2048] - cols[0]
            fit = shifts[shifts >= 0]
            for c in cols:
                fit = fit[free[fit + c]]
                if not len(fit):
                    break
            if len(fit):
                break
        shift = int(fit[0])
        merged = dict(row)
        free[shift + cols] = False
        cells[shift + cols] = [(merged[c] - HALF) << 16 | a for c in cols.tolist()]
        first[a] = shift
        used += len(cols)
        if used > 256:
            open_cells, used = open_cells[free[open_cells]], 0
    return first, cells[: int(np.flatnonzero(~free)[-1]) + 1].tolist()


def _tables(v: Vocabulary, memo: dict[str, list[int]] | None = None) -> Column:
    """The tables as one value: byte ids, rank rows, word tables and their ids.

    The value is a scalar subquery over one row, so plans name it without
    printing it, and it reaches the tasks as one block of bytes.
    """
    words = []
    for b, i in sorted(v.ids.items(), key=lambda e: e[1]):
        try:
            words.append((*word_slots(b), (b.decode("utf-8"), [i])))
        except UnicodeDecodeError:
            continue
    words += [(*word_slots(w.encode()), (w, i)) for w, i in (memo or {}).items()]
    w = two_choice(words, WORD_SLOTS)
    part = lambda t, j: [e[2][j] if e else None for e in t]
    row = (v.byte_id, *rank_rows(v), part(w[0], 0), part(w[1], 0), part(w[0], 1), part(w[1], 1))
    kind = "t struct<bytes:array<int>,first:array<int>,cells:array<int>,w0:array<string>,w1:array<string>,i0:array<array<int>>,i1:array<array<int>>>"
    return SparkSession.active().createDataFrame([(row,)], kind, verifySchema=False).coalesce(1).scalar()


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _id(e: Column) -> Column:
    return e.bitwiseAND(2 * HALF - 1)


def _place(t: Column, a: Column, b: Column) -> Column:
    """What a word's array holds for token a before token b (null: the end)."""
    cell = F.get(t["cells"], F.get(t["first"], a) + b)
    return F.when(_id(cell) == a, cell).otherwise(a + NEVER)


def _merged(t: Column, word: Column) -> Column:
    """Ids of a word by folding merges over its bytes."""
    letters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    first = F.transform(letters, lambda c: F.get(t["bytes"], F.ascii(c)))
    start = _let(first, lambda ids: F.transform(ids, lambda a, i: _place(t, a, F.get(ids, i + 1))))

    def step(e: Column, _) -> Column:
        def put(m: Column, p: Column) -> Column:
            """The merged token at p (from 0), its left neighbour's new rank, and no right half."""
            new = F.shiftright(m, 16) + HALF
            here, left = _place(t, new, _id(F.get(e, p + 2))), lambda x: _place(t, _id(x), new)
            put_in = F.transform(e, lambda x, i: F.when(i == p, here).when(i == p - 1, left(x)).otherwise(x))
            return F.filter(put_in, lambda x, i: i != p + 1)

        def merge(m: Column) -> Column:
            return F.when(m >= NEVER, e).otherwise(_let(F.array_position(e, m).cast("int") - 1, lambda p: put(m, p)))

        return _let(F.array_min(e), merge)

    fold = lambda e: F.when(F.size(e) < 2, e).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(e)), e, step))
    return F.transform(_let(start, fold), _id)


def _ids(t: Column, word: Column, long: Column) -> Column:
    """Ids of a word: looked up where it is a token or in the memo, else ``long`` beyond LONG bytes, else folded."""
    h = F.xxhash64(word)
    s0, s1 = h.bitwiseAND(WORD_SLOTS - 1).cast("int"), F.shiftright(h, 24).bitwiseAND(WORD_SLOTS - 1).cast("int")
    known = F.when(F.get(t["w0"], s0) == word, F.get(t["i0"], s0)).when(F.get(t["w1"], s1) == word, F.get(t["i1"], s1))
    return known.when(F.octet_length(word) > LONG, long).otherwise(_merged(t, word))


def _split(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def memo_words(texts: DataFrame, path: str) -> dict[str, list[int]]:
    """Ids of the most frequent words of several tokens in a sample of about MEMO_DOCS rows of (doc_id, text).

    The memo only spares folding them again and again: any other word is folded
    where it occurs. Its bound, MEMO_WORDS, doesn't depend on the corpus.
    """
    v, total = vocabulary(path), texts.count()
    share = min(1_000_000, -(-1_000_000 * MEMO_DOCS // max(1, total)))
    drawn = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    words = drawn.select(F.explode(_split(F.col("text"))).alias("word"))
    often = words.groupBy("word").count().where((F.col("count") > 1) & (F.octet_length("word") <= LONG)).orderBy(F.desc("count"), "word").limit(MEMO_WORDS + len(v.ids))
    rare = [w for w in often.select("word").toArrow()["word"].to_pylist() if w.encode() not in v.ids][:MEMO_WORDS]
    if not rare:
        return {}
    table = texts.sparkSession.createDataFrame(pa.table({"word": rare})).repartition(min(64, 1 + len(rare) // 2000))
    table = table.select("word", _tables(v).alias("__t"))  # named once, so that it is never written into a row
    rows = table.select("word", _let(F.col("__t"), lambda t: _merged(t, F.col("word"))).alias("ids")).toArrow().to_pylist()
    return {r["word"]: r["ids"] for r in rows}


def merge_word(word: bytes, v: Vocabulary) -> list[int]:
    """Ids of one word of any length: the same merges, O(n log n) with a heap over a linked list."""
    if word in v.ids:
        return [v.ids[word]]
    ids = [v.byte_id[b] for b in word]
    n = len(ids)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := v.pairs.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i] = v.pairs[(a, b)][1]
        gone[j] = 1
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y >= 0 and (p := v.pairs.get((ids[x], ids[y]))):
                heapq.heappush(heap, (p[0], x, ids[x], ids[y]))
    return [ids[i] for i in range(n) if not gone[i]]


_WORDS = regex.compile(PATTERN)


def encode_text(text: str | None, v: Vocabulary) -> list[int]:
    return [i for w in _WORDS.findall(text or "") for i in merge_word(w.encode("utf-8"), v)]


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of every row's text, without special tokens.

    A null and an empty text both give an empty list; a blank text is encoded as
    it stands. Strings of special tokens are ordinary text. Rows with a null or
    repeated id are kept as they are; other columns of ``df`` are not read. An
    empty table gives an empty result. ``path`` names the vocabulary file.
    """
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    memo = memo_words(slim, path)

    def heap(words: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([[merge_word(w.encode("utf-8"), v) for w in ws] for ws in words.to_pylist()], pa.list_(pa.list_(pa.int32())))

    words = slim.select("doc_id", F.coalesce(_split(F.col("text")), F.array().cast("array<string>")).alias("w"))
    over = F.filter("w", lambda x: F.octet_length(x) > LONG)  # empty for nearly all texts
    words = words.withColumn("__l", over).withColumn("__i", F.arrow_udf(heap, "array<array<int>>")("__l"))
    words = words.withColumn("__t", _tables(vocabulary(path), memo))
    long = lambda x: F.get("__i", F.array_position("__l", x).cast("int") - 1)
    each = lambda t: F.transform("w", lambda x: _ids(t, x, long(x)))
    return words.select("doc_id", F.flatten(_let(F.col("__t"), each)).alias("ids"))


def decode(df: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): the tokens' byte strings joined; an empty text for a null array, unknown ids give nothing."""
    v = vocabulary(path)
    row = ([v.pieces.get(i, b"").decode("latin-1") for i in range(max(v.pieces) + 1)],)
    pieces = df.sparkSession.createDataFrame([row], "p array<string>", verifySchema=False).coalesce(1).scalar()
    slim = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"), pieces.alias("__p"))
    joined = _let(F.col("__p"), lambda p: F.array_join(F.transform("ids", lambda i: F.get(p, i)), ""))
    return slim.select("doc_id", F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8").alias("text"))

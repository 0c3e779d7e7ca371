"""Template residue, filler, error pages and demands for scripts in place of a message.

A linear classifier (logistic loss, L2) scores the sentences of a sender's own
message by hashed word n-grams, lengths and features of the title. It learns from
weak labels: a title with an unfilled field, a short message that opens with a
response status or a stock phrase, a salutation with an unfilled field, several
such fields. What tells mails that write about a template or cite a message from
those that are one is not listed anywhere: it is learned from longer mails with
a single field or phrase among ordinary sentences. The classifier is fitted on a
bounded sample of documents and validated on hosts (sender domains) that it has
not seen; the disclaimers are counted over all documents. A document is found if
its own message consists of such sentences, or if one of its sentences was sent
with a field left unfilled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasefold.session import materialize

from .mail import parts, strip_markup, subject

BITS = 17
SIZE = 1 << BITS
EXTRA = 64  # places kept for lengths and title features

# Delimiters of common template languages and what unset values print as.
FIELD = re.compile(
    r"\{\{\s*[\w .]{1,40}\s*\}\}|\{%\s*[\w .]{1,40}\s*%\}|\[\[\s*[\w .]{1,40}\s*\]\]|<<\s*[\w .]{1,40}\s*>>|«\s*[\w .]{1,40}\s*»|\$\{\s*[\w .]{1,40}\s*\}"
    r"|#\{\s*[\w .]{1,40}\s*\}|\*\|\s*[\w .]{1,40}\s*\|\*|@@\s*[\w .]{1,40}?\s*@@|<%=?\s*[\w .]{1,40}\s*%>|&lt;\s*[\w .]{1,40}\s*&gt;|\$[A-Za-z][\w .]{0,38}[A-Za-z]\$"
    r"|%[A-Za-z][\w .]{1,38}[A-Za-z]%|%(?:\d+\$)?[sd]\b|%\(\w{1,40}\)s|\[[A-Za-z][\w .]{1,38}\]|\{\d{1,2}\}|\{\s*[A-Za-z][\w .]{0,38}\s*\}|__[A-Za-z][\w .]{0,38}?[A-Za-z]__|(?<!\w)_{3,}(?!\w)"
    r"|#REF!|#N/A|#VALUE!|<no value>|\(null\)|\bundefined\b|\bNaN\b|(?<=\s)null(?=[\s.,!?]|$)|(?<=\s)None(?=[.,!?]|$)|<[A-Za-z_.]{3,30}>"
)
_MAYBE_FIELD = re.compile(r"[\[{<«$#*@%_&(]|undefined|NaN|null|None")
# Phrases of response statuses, script demands and filler.
PHRASE = re.compile(
    r"\b(?:error|erreur|fehler|erro|status|http)\s*(?:40[0-9]|50[0-9])\b|\((?:40[0-9]|50[0-9])\)|not found|forbidden|bad gateway|gateway timeout|unavailable|server error|access denied|too many requests"
    r"|session (?:has )?expired|log in again|traceback|moved or deleted|went wrong|\boops\b|try again"
    r"|javascript|enable scripts|allow scripts|cookies must be on|checking your browser"
    r"|introuvable|nicht gefunden|nicht verfügbar|später erneut|abgelaufen|ausführung von skripten|a expiré|désactivés|desactivad|aktivieren|no se encontró|no está disponible|denegado|sesión|não encontrad|indisponível|indisponible"
    r"|lorem|ipsum|\btodo\b|\bx{3,}|goes here|message here|text here|to follow|test test|placeholder|own words|asdf|steht später|texte du message|texto de ejemplo",
    re.I,
)
_QUOTED = re.compile(r"[\"“”„]")
_TOKEN = re.compile(r"|[^\W\d_]+|\d+|[\"“”„«»]|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=。)\s*|\n{2,}")
_QUOTE_HEAD = re.compile(r"(?:\bwrote(?: on\b.*)?\s*:?|\ba\s+écrit\s*:|\bschrieb\b.*:|\bescribió\s*:|\bescreveu\s*:|さんは書きました\s*:)\s*$")
_FORWARD = re.compile(r"^-{2,} ?(?:Original Message|Forwarded|Ursprüngliche Nachricht|Message d'origine)")
_HOST = re.compile(r"^from:.*@([\w.-]+)", re.I | re.M)
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>.*?</noscript\s*>", re.I | re.S)


def own_message(raw: str) -> str:
    """What the sender says: the longest text or HTML leaf without quotes and signature."""
    best = ""
    for p in parts(raw):
        if p.kind == "attached":
            continue
        text = p.text
        if p.kind == "html":
            bare = strip_markup(_NOSCRIPT.sub(" ", text))
            text = bare if bare.strip() else strip_markup(text)
        text = _own_lines(text)
        if len(text) > len(best):
            best = text
    return best


def _own_lines(text: str) -> str:
    """Lines of a text that are neither quoted nor signature.

    A quote begins with its head ('... wrote:'), which may be broken over two
    lines. Where the quoted lines are marked (> or |), unmarked lines below them
    are the sender's again; an unmarked quote reaches to the end.
    """
    if not text.isascii():
        text = _ODD.sub("", text).replace("\xa0", " ")
    lines = text.split("\n")
    out: list[str] = []
    unmarked = signed = False  # inside an unmarked quote; below the signature's mark
    for i, x in enumerate(lines):
        c = x.lstrip()[:1]
        if c == ">" or c == "|":
            unmarked = signed = False
            out.append("")
            continue
        if signed or unmarked:
            continue
        if x == "-- " or x == "--":
            signed = True
            continue
        if x.endswith(":") and (_QUOTE_HEAD.search(x) or (i and len(x) < 70 and _QUOTE_HEAD.search(lines[i - 1] + " " + x))):
            if not _QUOTE_HEAD.search(x) or not _HEAD_START.match(x):
                while out and out[-1].strip() and not _HEAD_START.match(out[-1]):
                    out.pop()
                if out and out[-1].strip():
                    out.pop()
            unmarked = not any(y.lstrip()[:1] in (">", "|") for y in lines[i + 1 : i + 4] if y.strip())
            continue
        if c == "-" and _FORWARD.match(x):
            unmarked = not any(y.lstrip()[:1] in (">", "|") for y in lines[i + 1 : i + 8])
            continue
        out.append(x)
    return "\n".join(out).strip()


_HEAD_START = re.compile(r"^(?:On |Le |Am |El |Em |[^<\n]{1,60}<[^<>\n]+@)")
_ODD = re.compile("[\ufeff\u200b-\u200d\xad\u2060]")


def sentences(text: str) -> list[str]:
    out = []
    for s in _SENTENCE.split(text):
        out += [x for x in _pieces(" ".join(s.split())) if any(c.isalnum() or c == "_" for c in x)]
    return out


PIECE = 2000  # longer sentences are judged in pieces


def _pieces(s: str) -> Iterator[str]:
    """A sentence in pieces of at most ``PIECE`` characters, cut between words and never within a field."""
    while len(s) > PIECE:
        cut = s.rfind(" ", 1, PIECE + 1)
        cut = cut if cut > 0 else PIECE
        for m in FIELD.finditer(s, max(0, cut - 100), cut + 100):
            if 0 < m.start() < cut < m.end():
                cut = m.start()
        yield s[:cut].strip()
        s = s[cut:].strip()
    yield s


def masked(sentence: str) -> str:
    return FIELD.sub("  ", sentence) if _MAYBE_FIELD.search(sentence) else sentence


def grams(mask: str) -> set[str]:
    """Word 1- and 2-grams; numbers are alike, an unfilled field is one word."""
    w = ["^", *_TOKEN.findall(_NUMBER.sub("9", mask.lower())), "$"]
    return {*w, *map(" ".join, zip(w, w[1:]))}


_NUMBER = re.compile(r"\d+")


def place(gram: str) -> int:
    return EXTRA + zlib.crc32(gram.encode("utf-8", "replace")) % (SIZE - EXTRA)


def lengths(mask: str, n_sentences: int, n_chars: int, title_field: bool) -> list[int]:
    out = [0, 1 + min(n_sentences, 12), 16 + min(int(math.log2(n_chars + 1)), 15)]
    if title_field:
        out.append(40)
    if "" in mask:
        out.append(41)
    return out


def features(mask: str, n_sentences: int, n_chars: int, title_field: bool) -> list[int]:
    """Places of a sentence's features: hashed n-grams, then lengths and title."""
    return [*map(place, grams(mask)), *lengths(mask, n_sentences, n_chars, title_field)]


class Memo(dict):
    """Weights by n-gram; hashing happens once for each, and the memo is emptied when it is full."""

    def __init__(self, weights: np.ndarray, room: int = 400_000):
        super().__init__()
        self.weights, self.room = weights, room

    def __missing__(self, gram: str) -> float:
        if len(self) >= self.room:
            self.clear()
        v = self[gram] = float(self.weights[place(gram)])
        return v


@dataclass
class Doc:
    title_field: bool
    parts: list[str]
    host: str


def take_apart(raw: str | None) -> Doc | None:
    """A document's own sentences; None for null, empty or blank texts and empty messages."""
    if not raw or not raw.strip():
        return None
    s = sentences(own_message(raw))
    host = _HOST.search(raw)
    title = subject(raw)
    return Doc(bool(_MAYBE_FIELD.search(title) and FIELD.search(title)), s, host[1].lower() if host else "") if s else None


def weak_labels(d: Doc, common: frozenset[str]) -> list[tuple[str, int]]:
    """Sentences with weak labels from title, status, phrase and salutation alone: 1 residue, 0 ordinary.

    Sentences of which neither can be said are left out.
    """
    own = [s for s in d.parts if s not in common]
    field = [bool(_MAYBE_FIELD.search(s) and FIELD.search(s)) for s in own]
    if d.title_field:
        return [(s, 1) for s, f in zip(own, field, strict=True) if f or not any(field)]
    if any(field):
        first = own[field.index(True)]
        salutation = field[0] and len(own[0].split()) <= 5
        alone = sum(field) == 1 and len(FIELD.findall(first)) == 1
        if sum(field) > 1 or salutation or (alone and len(first.split()) < 9):
            return [(s, 1) for s, f in zip(own, field, strict=True) if f]
        return [(s, 0) for s in own] if len(own) > 2 or _QUOTED.search(first) else []
    hits = [bool(PHRASE.search(s)) for s in own]
    n = sum(hits)
    if n == 0 or len(own) >= 4 * n or any(_QUOTED.search(s) for s, h in zip(own, hits, strict=True) if h):
        return [(s, 0) for s in own]
    if n == 1 and len(own) > 1 and len(own[hits.index(True)].split()) >= 9:
        return []
    return [(s, 1) for s in own] if 2 * n >= len(own) or (len(own) <= 4 and hits[0]) else []


@dataclass
class Model:
    """``accuracy``, ``precision`` and ``recall``: on the weakly labelled sentences of unseen hosts, of which ``held`` are residue."""

    weights: np.ndarray
    common: frozenset[str]
    accuracy: float = float("nan")
    precision: float = float("nan")
    recall: float = float("nan")
    held: int = 0


def fit(rows: list[tuple[list[int], int]], epochs: int = 4, rate: float = 0.3, l2: float = 1e-6) -> np.ndarray:
    """Weights of a logistic regression with L2, by AdaGrad over batches in a fixed random order."""
    w, g2 = np.zeros(SIZE), np.full(SIZE, 1e-4)
    if not rows:
        return w
    rng = np.random.default_rng(7)
    length = np.array([len(p) for p, _ in rows])
    flat = np.concatenate([np.asarray(p, dtype=np.int32) for p, _ in rows])
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    y = np.array([v for _, v in rows], dtype=float)
    weight = np.where(y > 0, len(y) / max(1.0, 2 * y.sum()), len(y) / max(1.0, 2 * (len(y) - y.sum())))
    weight = np.minimum(weight, 20.0)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), 256):
            b = order[a : a + 256]
            n = length[b]
            at = np.repeat(start[b] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            f, who = flat[at], np.repeat(np.arange(len(b)), n)
            z = np.bincount(who, weights=w[f], minlength=len(b))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) * weight[b]
            places, inv = np.unique(f, return_inverse=True)
            grad = np.bincount(inv, weights=err[who]) / len(b) + l2 * w[places]
            g2[places] += grad * grad
            w[places] -= rate * grad / np.sqrt(g2[places])
    return w


def shared_floor(n_docs: int) -> int:
    """Copies that make a sentence shared."""
    return max(8, n_docs // 1500)


def is_shared(s: str, n: int, last: int, others: int, floor: int) -> bool:
    return n >= floor and last > 0.7 * n and others > 2.5 * n and not FIELD.search(s) and not PHRASE.search(s)


def shared_sentences(docs: list[Doc]) -> frozenset[str]:
    """Disclaimers and the like: what many mails end with, word for word, after other sentences."""
    count, last, others = Counter(), Counter(), Counter()
    for d in docs:
        for i, s in enumerate(d.parts):
            count[s] += 1
            last[s] += i >= len(d.parts) - 3
            others[s] += len(d.parts) - 1
    floor = shared_floor(len(docs))
    return frozenset(s for s, n in count.items() if is_shared(s, n, last[s], others[s], floor))


def _whole(s: str) -> str:
    """A text that Arrow takes: some charsets decode to lone surrogates."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode()


def corpus_shared(apart: DataFrame, n_docs: int) -> frozenset[str]:
    """``shared_sentences`` of all documents, counted in Spark.

    Hashes are counted first, then the sentences behind the few that pass. A
    document has three last places and a shared sentence takes more than 0.7 *
    floor of them, so there are fewer than 3 * n_docs / (0.7 * floor), at most
    about 6,500 whatever the input.
    """
    floor = shared_floor(n_docs)
    each = apart.select(F.size("p").alias("size"), F.posexplode("p").alias("at", "s")).select(F.xxhash64("s").alias("h"), "s", (F.col("at") >= F.col("size") - 3).cast("long").alias("last"), (F.col("size") - 1).alias("others"))
    sums = [F.count("*").alias("n"), F.sum("last").alias("last"), F.sum("others").alias("others")]
    passed = (F.col("n") >= floor) & (F.col("last") > 0.7 * F.col("n")) & (F.col("others") > 2.5 * F.col("n"))
    few = each.groupBy("h").agg(*sums).where(passed).select("h")
    rows = each.join(F.broadcast(few), "h").groupBy("s").agg(*sums).where(passed).collect()
    return frozenset(r["s"] for r in rows if is_shared(r["s"], r["n"], r["last"], r["others"], floor))


def train(docs: list[Doc], common: frozenset[str] | None = None, least: float = 0.6) -> Model:
    """Fit on the hosts of four fifths, measure on the rest, then fit on all. ``common``: the shared sentences, else those of ``docs``.

    Raises ValueError where precision or recall on the unseen hosts falls below
    ``least``, if they hold enough residue (50 sentences) to tell.
    """
    common = shared_sentences(docs) if common is None else common
    rows, held = [], []
    for d in docs:
        own = [s for s in d.parts if s not in common]
        chars = sum(map(len, own))
        for s, v in weak_labels(d, common):
            (held if zlib.crc32(d.host.encode()) % 5 == 0 else rows).append((features(masked(s), len(own), chars, d.title_field), v))
    w = fit(rows)
    said, is_one = np.array([w[p].sum() > 0 for p, _ in held], dtype=bool), np.array([v == 1 for _, v in held], dtype=bool)
    share = lambda part, of: float(part.sum() / of.sum()) if of.any() else float("nan")
    m = Model(fit(rows + held), common, float((said == is_one).mean()) if len(held) else float("nan"), share(said & is_one, said), share(said & is_one, is_one), int(is_one.sum()))
    if m.held >= 50 and (m.precision < least or m.recall < least):
        raise ValueError(f"the classifier fails on unseen hosts: precision {m.precision:.3f}, recall {m.recall:.3f}, asked for {least}")
    return m


def judge(d: Doc | None, m: Model, memo: Memo, share: float = 0.5) -> bool:
    """Whether a document is residue: by an unfilled field, or by the share of its own characters."""
    if d is None:
        return False
    own = [s for s in d.parts if s not in m.common]
    chars = sum(map(len, own))
    base = float(m.weights[lengths("", len(own), chars, d.title_field)].sum())
    field = float(m.weights[41])
    bad = 0
    for s in own:
        k = masked(s)
        said = sum(map(memo.__getitem__, grams(k)))  # words never seen say nothing, whatever the lengths
        if said > 0.5 and said + base + (field if "" in k else 0.0) > 0:
            if "" in k:
                return True
            bad += len(s)
    return bad > share * chars


def fit_sample(apart: DataFrame, sample: int = 12_000) -> Model:
    """A model from about ``sample`` documents, drawn by a hash of the id (the bound of what reaches the driver)."""
    total = apart.count()
    part = min(1_000_000, math.ceil(1e6 * sample / max(1, total)))
    rows = apart.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part).select("t", "p", "h").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["h"], r["p"]))  # the order of arrival must not matter
    return train([Doc(r["t"], r["p"], r["h"]) for r in rows], corpus_shared(apart, total))


def find_residue(df: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 12_000) -> DataFrame:
    """(doc_id) of the documents to exclude.

    Null, empty and blank texts are never found. A null id is kept as null.
    Repeated rows are found as often as they come. An empty table gives an empty
    result. Other columns of ``df`` are not read.
    """
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = list(map(take_apart, b.column("text").to_pylist()))
            ids = b.column("doc_id").filter(pa.array([d is not None for d in docs], pa.bool_()))
            docs = [d for d in docs if d]
            yield pa.RecordBatch.from_arrays([ids, pa.array([d.title_field for d in docs], pa.bool_()), pa.array([list(map(_whole, d.parts)) for d in docs], pa.list_(pa.string())), pa.array([d.host for d in docs], pa.string())], ["doc_id", "t", "p", "h"])

    # taken apart once, for the counts, the sample and the verdict
    apart = materialize(slim.where("text IS NOT NULL AND trim(text) <> ''").mapInArrow(split, f"doc_id {kind}, t boolean, p array<string>, h string"))
    model = slim.sparkSession.sparkContext.broadcast(fit_sample(apart, sample))  # SIZE weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        memo = Memo(m.weights)
        for b in batches:
            hit = [judge(Doc(t, p, ""), m, memo) for t, p in zip(b.column("t").to_pylist(), b.column("p").to_pylist(), strict=True)]
            yield b.select(["doc_id"]).filter(pa.array(hit, pa.bool_()))

    return apart.select("doc_id", "t", "p").mapInArrow(run, f"doc_id {kind}")

"""Training-data operators: brute force, round trips and edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phasefold.llm import leaks, mail, residue, splits, tokens, topn, vectors

tokenizer_files = pytest.importorskip("public_tokenizers")
BPE = tokenizer_files.path("byte_bpe_50k.json")


# --- top N


def test_loser_tree_merges_like_sorting():
    rng = np.random.default_rng(0)
    for _ in range(50):
        runs = [sorted((int(x), i) for x in rng.integers(0, 9, rng.integers(0, 7))) for i in range(rng.integers(1, 9))]
        n = int(rng.integers(0, 20))
        assert topn.merge_runs(runs, n) == sorted(sum(runs, []))[:n]


def test_top_n_against_sorting(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(a), int(b), float(rng.integers(0, 4))) for g in range(6) for a in range(8) for b in range(12)]
    rows += [(9, 1, 1, None), (9, 1, 2, float("nan")), (9, 1, 3, float("inf")), (None, 1, 1, 0.0), (9, None, 1, 0.0), (9, 2, 2, 5.0)]
    df = spark.createDataFrame(rows, "g long, a long, b long, s double").withColumn("rank", F.lit(1))
    limits = spark.createDataFrame([(g, g) for g in range(6)] + [(9, 4)], "g long, n long")
    got = sorted(tuple(r) for r in topn.top_n(df, ["g"], "s", ["a", "b"], limits, "g", "n").collect())
    want = []
    for g in range(6):
        best = sorted((s, a, b) for h, a, b, s in rows if h == g)[:g]
        want += [(g, a, b, i + 1) for i, (s, a, b) in enumerate(best)]
    assert got == sorted([*want, (9, 2, 2, 1)])
    hot = limits.unionByName(spark.createDataFrame([(77, 10**9)], "g long, n long"))  # a huge N of another group cuts nothing off less
    for shuffled in (topn.top_n(df, ["g"], "s", ["a", "b"], hot, "g", "n", broadcast_rows=0), topn.top_n(df, ["g"], "s", ["a", "b"], hot.where("g <> 9"), "g", "n", default_n=4, broadcast_rows=0)):
        assert sorted(tuple(r) for r in shuffled.collect()) == sorted([*want, (9, 2, 2, 1)])
    assert topn.top_n(df.where("false"), ["g"], "s", ["a", "b"], limits, "g", "n").count() == 0


# --- splits


def brute_ties(rows):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a, b, c in rows:
        keys = [("r", k) for k in (a, b) if k is not None]
        digits = "".join(ch for ch in c or "" if ch.isdigit()).lstrip("0")
        if digits:
            keys.append(("o", "".join(ch for ch in c if ch.isalpha()).upper(), digits))
        for k in keys:
            x, y = root(("i", i)), root(k)
            parent[max(x, y)] = min(x, y)
    first = {}
    for i, *_ in rows:
        first.setdefault(root(("i", i)), []).append(i)
    return {(i, min(g)) for g in first.values() for i in g}


def test_ties_and_splits(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 120)), None if rng.random() < 0.3 else int(rng.integers(0, 120)), [None, "n/a", "", f"Obs-{rng.integers(0, 400):05d}", f"OBS{rng.integers(0, 400)}"][rng.integers(0, 5)]) for i in range(150)]
    rows += [(1000 + i, 5000 + i, 5001 + i, None) for i in range(40)]  # a long chain
    rows += [(2000, None, None, None), rows[0]]
    df = spark.createDataFrame(rows, "i long, a long, b long, c string").withColumn("root", F.lit(1))
    got = splits.tie_records(df, "i", ["a", "b"], "c")
    assert {tuple(r) for r in got.collect()} == brute_ties(rows)
    parts = splits.assign_splits(got, {"train": 0.8, "validation": 0.1, "test": 0.1}, bins=20).collect()
    assert len(parts) == len({r[0] for r in rows})
    by = dict(map(tuple, parts))
    assert all(by[i] == by[j] for i, j in brute_ties(rows))
    assert splits.tie_records(df.where("false"), "i", ["a", "b"], "c").count() == 0


def test_components_by_rounds_equal_those_of_one_task(spark):
    rng = np.random.default_rng(12)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(30)] + [(5, 5), (None, 3), (7, None)]
    df = spark.createDataFrame(e, "a long, b long")
    one, many = ({tuple(r) for r in splits.components(df, task_links=n).collect()} for n in (10**6, 20))
    assert one == many
    node, root = splits.roots(*np.array([x for x in e if None not in x]).T)
    assert one == set(zip(node.tolist(), root.tolist(), strict=True))


def test_splits_balance_level_by_level(spark):
    rng = np.random.default_rng(13)
    ties = spark.createDataFrame([(i, int(g)) for i, g in enumerate(rng.integers(0, 900, 4000))], "record long, first long")
    got = splits.assign_splits(ties, {"train": 0.8, "validation": 0.1, "test": 0.1}, bins=20, per_task=50).join(ties, "record")
    assert got.count() == 4000 and got.groupBy("first").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    n = {r[0]: r[1] for r in got.groupBy("split").count().collect()}
    assert abs(n["train"] - 3200) < 60 and abs(n["validation"] - 400) < 60


def test_difference_bins_balances():
    w = np.random.default_rng(3).integers(1, 50, 500).astype(float)
    sums = np.bincount(splits.difference_bins(w, 10), weights=w)
    assert sums.max() - sums.min() <= 2 and sums.sum() == w.sum()
    names = splits.allocate(sums, {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert names.count("train") == 8 and names.count("test") == 1
    assert splits.difference_bins(np.array([]), 4).tolist() == []


# --- vectors


def test_similar_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 6)).cumsum(0) / 8
    x[500:508] = x[499]  # copies beyond k
    x[600] = x[601]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (2000, None), (2001, [1.0]), (2002, [float("nan")] * 6), (2003, [None] * 6), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "i long, v array<double>").withColumn("cell", F.lit(0))
    got = vectors.similar(df, "i", F.col("v"), 6, k=5, per_cell=60).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    hits = 0
    for i, g in got.groupby("id"):
        assert len(g) == 5 and i not in set(g.other)
        want = np.lexsort((np.arange(900), d[i]))[:5]
        hits += len(set(want.tolist()) & set(g.other))
    assert got.id.nunique() == 900 and hits / 4500 > 0.95
    copies = got[got.id == 505].sort_values("rank")
    assert copies.other.tolist() == [499, 500, 501, 502, 503] and (copies.distance == 0).all()
    assert vectors.similar(df.where("false"), "i", F.col("v"), 6).count() == 0


def test_similar_misses_nothing_outside_the_probed_cells(spark):
    x = np.random.default_rng(9).normal(size=(1500, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :5]
    for within in (float("inf"), 2.2):
        got = vectors.similar(df, "i", F.col("v"), 12, probes=2, rerank=8, per_cell=30, within=within).select("id", "rank", "other").collect()
        assert {tuple(r) for r in got} == {(i, n + 1, int(j)) for i, row in enumerate(order) for n, j in enumerate(row) if d[i, j] <= within}


def test_score_aware_codes_prefer_small_parallel_error():
    x = np.random.default_rng(5).normal(size=(2000, 8))
    err = {}
    for eta in (1.0, 8.0):
        book = vectors.fit_codebook(x, 4, eta=eta)
        cell = vectors.nearest_centres(x, book.centres)[:, 0]
        c, e = book.codes(x, cell)
        r = x - book.centres[cell]
        assert np.allclose(e, r - np.concatenate([book.words[m][c[:, m]] for m in range(len(book.cuts))], axis=1))
        err[eta] = ((e * r).sum(1) / np.linalg.norm(r, axis=1)).std()
        block = vectors.Block(book, 0, np.arange(len(x)), x, book.pack(c), np.linalg.norm(e, axis=1))
        assert np.allclose(block.scan(x[:50] - book.centres[0]), (x[:50] - book.centres[0]) @ (r - e).T, atol=1e-4)
    assert err[8.0] < err[1.0]


# --- tokens

TEXTS = ["", None, " ", "\n\n  x", "a" * 500, "é" * 300 + " b", "<|endoftext|> hi", "don't we'll I'VE", "x" * 20000 + " " * 300 + "y", "日本語テキスト" * 50, "𝕏𝕪 👍🏽 " * 30, "\x00\x85 a　​ c", "1234567890" * 40, "Zorholm SKyJfPBzaWqp\r\n\t end "]


def test_tokens_equal_the_library_and_decode_back(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(TEXTS)], "doc_id long, text string, ids int")
    ids = tokens.encode(df, BPE)
    got = {r["doc_id"]: list(r["ids"]) for r in ids.collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    back = {r[0]: r[1] for r in tokens.decode(ids, BPE).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}
    assert [tokens.encode_text(x, tokens.vocabulary(BPE)) for x in TEXTS] == [got[i] for i in range(len(TEXTS))]
    assert tokens.encode(df.where("false"), BPE).count() == 0


# --- mail, leaks, residue


def test_mail_parts():
    raw = 'Subject: =?utf-8?Q?caf=C3=A9_{{x}}?=\r\nContent-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nna=C3=AFve li=\r\nne\r\n--b\r\nContent-Type: application/octet-stream; name="a.txt"\r\nContent-Transfer-Encoding: base64\r\nContent-Disposition: attachment\r\n\r\naGVsbG8gd29ybGQ=\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>a <b>b</b>c &amp; d</p>\r\n--b--\r\n'
    got = list(mail.parts(raw))
    assert [p.kind for p in got] == ["plain", "attached", "html"]
    assert got[0].text.strip() == "naïve line" and got[1].text == "hello world" and mail.strip_markup(got[2].text).split() == ["a", "bc", "&", "d"]
    assert mail.subject(raw) == "café {{x}}"
    assert mail.from_base64("aGVs\nbG8=IHdv\ncmxk") == b"hello world" and mail.readable("wide é".encode("utf-16"), "utf-16") == "wide é"
    assert mail.readable(b"text " * 2000 + b"\0", None) is None and mail.readable(b"\xff\xfe" + b"plain text " * 3000, None).endswith("text ")
    assert list(mail.parts(None)) == [] and list(mail.parts("")) == [] and mail.subject(None) == ""


PASSAGE = "Neither ferment nor sample repels what the cheap membrane of Zorpelreach leaves behind and a potter of Zawick absorbs noisy temperature more than five hundred times per spreadsheet while the glacier rests"


def brute_longest(items, tokens_):
    """Longest common run of words ending at each position."""
    out = []
    for k in range(len(tokens_)):
        best = 0
        for _, w in items:
            for p in range(len(w)):
                n = 0
                while n <= min(k, p) and tokens_[k - n] == w[p - n]:
                    n += 1
                best = max(best, n)
        out.append(best)
    return out


def test_automaton_knows_longest_runs():
    rng = np.random.default_rng(6)
    items = [(i, [chr(97 + c) for c in rng.integers(0, 3, 12)]) for i in range(4)]
    seq = [chr(97 + c) for c in rng.integers(0, 4, 80)]
    auto = leaks.Automaton(items)
    want = brute_longest(items, seq)
    assert [(k, n) for k, _, n in auto.stream(seq)] == [(k, n) for k, n in enumerate(want) if n >= leaks.RUN]
    for k, v, _ in auto.stream(seq):
        run = seq[k - leaks.RUN + 1 : k + 1]
        assert auto.places[auto.base[v]] == [(i, p) for i, w in items for p in range(leaks.RUN - 1, len(w)) if w[p - leaks.RUN + 1 : p + 1] == run]


    for item, w in items:
        runs = set()
        for k in range(len(seq)):
            for p in range(len(w)):
                n = 0
                while n <= min(k, p) and seq[k - n] == w[p - n]:
                    n += 1
                if n >= leaks.RUN and not (k + 1 < len(seq) and p + 1 < len(w) and seq[k + 1] == w[p + 1]):
                    runs.add((k, p, n))
        assert set(auto.runs(seq).get(item, [])) == runs


@given(st.text(alphabet="aé x̃ỹ\u0301\u200bﬁß\xadÅ日.-_ \n'", max_size=40))
@settings(max_examples=300, deadline=None)
def test_words_carry_their_places(text):
    at = leaks.word_places(text)
    assert [leaks.words(text[a:b]) for a, b in at] == [[w] for w in leaks.words(text)]
    assert all(b <= c for (_, b), (c, _) in zip(at, at[1:]))


def test_removal_keeps_all_other_text(spark):
    before, after = "été déjà x̃ỹ ½ before\u200b, ", " after ﬁn."
    passage = PASSAGE.replace("glacier", "gla\u0301cier\u200b")
    raw = "Subject: x\n\n" + before + passage + after
    items = spark.createDataFrame([(7, PASSAGE), (8, "two words")], "item_id long, passage string")
    docs = spark.createDataFrame([(1, raw), (2, None), (3, ""), (1, raw), (4, "Subject: y\n\nnothing here"), (5, "Subject: y\n\nany two words, here")], "doc_id long, text string").withColumn("parts", F.lit(1))
    got = sorted(map(tuple, leaks.remove_leaks(docs, items).collect()))
    n = len(leaks.words(PASSAGE))
    assert got == [(1, before + after, 1, n), (1, before + after, 1, n), (2, None, 0, 0), (3, "", 0, 0), (4, "nothing here", 0, 0), (5, "any , here", 1, 2)]
    assert leaks.remove_leaks(docs.where("false"), items).count() == 0 and leaks.remove_leaks(docs, items.where("false")).count() == 6
    again = leaks.remove_leaks(docs, items)
    assert leaks.leaked_spans(again, items).count() == 0


def test_leaks(spark):
    w = PASSAGE.split()
    head = "Subject: x\n\n"
    odd = w.copy()
    odd[6], odd[12], odd[13] = "chaep", w[13], w[12]
    docs = [
        (1, head + "Dear all,\n> " + PASSAGE.upper().replace(" ", "\n> ") + "\nbye"), (2, head + "<p>" + " ".join(f"<b>{x}</b>," for x in w[4:22]) + "</p>"), (3, head + " ".join(w[:10]) + " and nothing else"),
        (4, head + " ".join(odd)), (5, None), (6, ""), (7, " "), (8, head + "other words entirely"), (1, head + PASSAGE), (None, head + PASSAGE),
    ]
    items = spark.createDataFrame([(7, PASSAGE), (7, PASSAGE), (8, None), (9, ""), (10, "only four words here")], "item_id long, passage string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    got = leaks.leaked_spans(df, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 7), (2, 7), (4, 7), (None, 7)}
    assert leaks.leaked_spans(df.where("false"), items).count() == 0 and leaks.leaked_spans(df, items.where("false")).count() == 0
    text = "before " + PASSAGE + " after"
    auto = leaks.Automaton([(7, leaks.words(PASSAGE))])
    cut = [(s[1], s[2]) for s in leaks.spans(auto, leaks.words(text))]
    assert leaks.without_spans(text, cut).split() == ["before", "after"]


def test_spans_with_edits_inside_and_at_the_ends():
    w = leaks.words(PASSAGE)
    auto = leaks.Automaton([(7, w)])
    fifteen = w[:15]
    swap = lambda x, i: [*x[:i], x[i + 1], x[i], *x[i + 2 :]]
    change = lambda x, *at: ["qqq" if i in at else v for i, v in enumerate(x)]
    edited = {
        "two inside": change(fifteen, 4, 10), "swap inside": swap(fifteen, 7), "two added": [*fifteen[:4], "qqq", *fifteen[4:10], "qqq", *fifteen[10:]], "three of twenty": change(w[:20], 5, 10, 15),
        "second and last but one": [w[0], "fermnet", *w[2:13], "nad", w[14]], "swap at the end": swap(fifteen, 13), "misspelled at both ends": ["nither", *w[1:15], "pottre"], "added before the last": [*w[:14], "qqq", w[14]], "swap and change": change(swap(fifteen, 7), 3),
    }
    for name, x in edited.items():
        found = leaks.spans(auto, ["so", *x, "bye"])
        assert len(found) == 1 and found[0][:3] == (7, 1, len(x)), (name, found)
    assert leaks.spans(auto, ["so", *w[:11], "bye"]) == [] and leaks.spans(auto, ["so", *change(fifteen, 3, 6, 9, 12), "bye"]) == []


def corpus():
    rng = np.random.default_rng(8)
    noun = ["sensor", "ledger", "harbour", "reagent", "budget", "valve", "trawler", "script"]
    say = lambda: f"We {rng.choice(['counted', 'moved', 'checked'])} {rng.integers(2, 900)} of the {rng.choice(noun)} records and sent the rest to the {rng.choice(noun)}."
    docs, bad = [], set()
    for i in range(1500):
        head = f"From: a@{'abcdefgh'[i % 8]}.example\nSubject: about the {rng.choice(noun)}\n\n"
        body = "\n\n".join(say() for _ in range(1 + i % 4))
        kind = i % 25
        if kind == 0:
            body = "Please enable JavaScript to view this message."
        elif kind == 1:
            body = f"Error {rng.choice([404, 502, 503])}: Service unavailable. Try again later."
        elif kind == 2:
            body = "Dear {{ first_name }},\n\n" + body
        elif kind == 3:
            body = "Lorem ipsum dolor sit amet nostrud. Ut ipsum sed aliqua lorem."
        elif kind == 4:
            body += '\n\nDoes anyone know why our template engine prefers {{ x }} over [[y]]?'
        elif kind == 5:
            body = "On Monday, A wrote:\n\n> Please enable JavaScript to view this message.\n\n" + body
        if kind < 4:
            bad.add(i)
        docs.append((i, head + body))
    return docs, bad


def test_residue(spark):
    docs, bad = corpus()
    extra = [(9001, None), (9002, ""), (9003, "  \n "), (9004, "Subject: x\n\n" + "word " * 50000)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("p", F.lit(1))
    got = [r[0] for r in residue.find_residue(df).collect()]
    assert set(got) == bad and len(got) == len(bad)
    assert residue.find_residue(df.where("false")).count() == 0
    model = residue.train([d for d in (residue.take_apart(t) for _, t in docs) if d])
    assert model.accuracy > 0.95


def test_shared_sentences_are_counted_over_all_documents(spark):
    docs, bad = corpus()
    note = " This message is meant for the addressee only and binds nobody."
    tail = "\n\n" + "\n\n".join(f"{note.strip()[:-1]}, {x}." for x in ("says the house", "says the office", "says the station"))
    docs = [(i, t + tail if i % 25 in (1, 7, 9) else t) for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = []
    real = residue.train
    residue.train = lambda d, common=None: seen.append((len(d), common)) or real(d, common)
    try:
        residue.find_residue(df, sample=60)
    finally:
        residue.train = real
    (n, common), whole = seen[0], residue.shared_sentences([d for d in (residue.take_apart(t) for _, t in docs) if d])
    assert n < 150 and common == whole and len([s for s in whole if s.startswith(note.strip()[:-1])]) == 3


def test_long_sentences_are_judged_whole():
    real, filler = "we counted ledger records and sent them on " * 60, "lorem ipsum dolor sit amet nostrud " * 60
    d = residue.take_apart("Subject: x\n\n" + real + filler * 2)
    assert len(d.parts) > 2 and max(map(len, d.parts)) <= 2000 and " ".join(d.parts) == " ".join((real + filler * 2).split())
    weights = np.zeros(residue.SIZE)
    weights[[residue.place(g) for g in ("lorem", "ipsum", "nostrud")]] = 1.0
    m = residue.Model(weights, frozenset())
    assert residue.judge(d, m, residue.Memo(weights))
    assert not residue.judge(residue.take_apart("Subject: x\n\n" + filler + real * 3), m, residue.Memo(weights))
    cut = residue.sentences("word " * 398 + "{{ first name }} " + "word " * 30)
    assert "{{ first name }}" in " ".join(cut) and any("{{ first name }}" in x for x in cut)


def test_own_message():
    raw = "Subject: x\n\nMine first.\n\nOn Tue, 1 May 2001, A B wrote:\n\n> theirs\n>\n> more\n\nMine again.\n\n-- \nName\nTel. 1\n"
    assert residue.own_message(raw).split("\n")[0] == "Mine first." and "theirs" not in residue.own_message(raw) and "Mine again." in residue.own_message(raw) and "Tel" not in residue.own_message(raw)

"""The operators for training text against brute force and on edge cases."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import lookalike, mixing, nearcopies, packing, scannoise, splitting, stuffing
from pagewright.llm.shingles import shingle_hashes, word_hashes
from pagewright.llm.tokens import with_lengths

WORDS = "the canal keeps a record of every page that the reader has seen in the old archive while paper tray model region of letters under a bridge near the water".split()
LEX = [("en", w) for w in dict.fromkeys(WORDS)] + [("en", "because"), ("en", "contract"), ("en", "lists")]


def rows(spark, texts, tbl="blocks", page=0, doc=1):
    return spark.createDataFrame([(tbl, i, doc, page, t) for i, t in enumerate(texts)], "tbl string, row_uid long, doc_id long, page_index int, text string")


def lexicon(spark):
    return spark.createDataFrame([(lang, w, 100) for lang, w in LEX], "lang string, word string, freq long")


# Shingles


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_word_hashes(texts):
    h, counts = word_hashes(texts)
    want = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    seen = {}
    for w, x in zip([w for ws in want for w in ws], h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    s, m = shingle_hashes(h, counts, 3)
    assert m.tolist() == [max(0, len(w) - 2) for w in want] and len(s) == m.sum()


# Near copies


def jaccard(a, b, k):
    s = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (re.findall(r"[^\W_]+", x.lower()) for x in (a, b))]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def corpus(n=160, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.4:
            w = r.choice(out).split()
            for _ in range(r.randint(0, 8)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
        else:
            out.append(" ".join(["at the request of"] + r.choices(vocabulary, k=60)))
    return [*out, out[0], None, "", "short text"]


@pytest.mark.parametrize("limit", [250, 4])
def test_near_copies(spark, limit):
    """Against all pairs; with a small limit, nodes are branched, pass through rounds and end in blocks."""
    texts = corpus()
    p = nearcopies.Params(threshold=0.5, shingle=3, min_words=40, node_limit=limit, sample_rows=40 if limit < 10 else 40_000)
    pairs, copies, _ = nearcopies.similar_pairs(rows(spark, texts).withColumn("a", F.lit(1)).withColumn("rep", F.lit("x")), p)
    got = {(r.uid_a, r.uid_b) for r in nearcopies.expanded(pairs, copies).collect()}
    real = [(i, t) for i, t in enumerate(texts) if t and len(t.split()) >= 40]
    want = {(i, j) for i, a in real for j, b in real if i < j and jaccard(a, b, 3) >= 0.5}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert (0, len(texts) - 4) in got


def test_near_copies_groups(spark):
    texts = corpus(60, 2)
    p = nearcopies.Params(threshold=0.5, shingle=3, min_words=40)
    g = {r.row_uid: (r.group_uid, r.links) for r in nearcopies.groups(rows(spark, texts).union(rows(spark, texts[:5])), p).collect()}
    assert len(g) == 61 and g[0][0] == g[60][0] and all(v[0] <= k for k, v in g.items())


def test_near_copies_empty(spark):
    p = nearcopies.Params()
    for texts in ([], [None, "", "x y"]):
        pairs, copies, _ = nearcopies.similar_pairs(rows(spark, texts), p)
        assert nearcopies.expanded(pairs, copies).count() == 0


def test_near_copies_identical(spark):
    """A text of a third of all rows is compared once."""
    same = " ".join(f"w{i}" for i in range(50))
    texts = [same] * 12 + [" ".join(f"v{i}_{j} v{j}" for i in range(50)) for j in range(24)]
    pairs, copies, _ = nearcopies.similar_pairs(rows(spark, texts), nearcopies.Params())
    assert pairs.count() == 0 and nearcopies.expanded(pairs, copies).count() == 12 * 11 // 2


def test_components(spark):
    e = spark.createDataFrame([("t", 1, 2), ("t", 2, 3), ("t", 9, 3), ("t", 20, 21), ("u", 1, 5)], "tbl string, a long, b long")
    got = {(r.tbl, r.node): r.root for r in nearcopies.components(e).collect()}
    assert got[("t", 9)] == got[("t", 2)] == got[("t", 3)] == 1 and got[("t", 21)] == 20 and got[("u", 5)] == 1


# Look-alikes


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Rev A1", "Ｒｅｖ　Ａ１", True), ("Rev A1", "Rev А1", True), ("inventory", "inven­to﻿ry", True), ("é", "é", True), ("ﬁle", "file", True), ("Βоχ", "Bоχ", True), ("a‑b", "a-b", True),
        ("а́", "á", True), ("µm", "μm", True), ("Rev", "REV", False), ("é", "e", False), ("m²", "m2", False), ("O", "0", False), ("α", "a", False), ("a – b", "a - b", False), ("a\nb", "a b", False),
    ],
)
def test_look(a, b, same):
    assert (lookalike.look(a) == lookalike.look(b)) is same


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_look_is_stable(s):
    once = lookalike.look(s)
    assert lookalike.look(once) == once and unicodedata.is_normalized("NFC", once)
    assert lookalike.fold(lookalike.fold(s)) == lookalike.fold(s)


def test_same_look(spark):
    texts = [(1, "Box A"), (2, "Bоx A"), (3, "Box A"), (3, "Box A"), (4, None), (5, ""), (6, " "), (7, "BOX A"), (8, "Box​ A"), (9, "x y " * 200_000 + "z"), (10, "ｘ y " * 200_000 + "z")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in texts], "block_uid long, text string, look string, uid int")
    assert {(r.a, r.b) for r in lookalike.same_look(df, "block_uid", "text").collect()} == {(1, 2), (2, 3), (1, 8), (3, 8), (2, 8), (9, 10)}
    assert {(r.a, r.b) for r in lookalike.same_look(df, "block_uid", "text", 1).collect()} == {(1, 2), (2, 3), (1, 8), (3, 8), (2, 8), (9, 10)}  # every key is split
    assert lookalike.same_look(df.where("false"), "block_uid", "text").count() == 0
    got = {r.uid: (r.class_uid, r.texts, r.links) for r in lookalike.classes(df, "block_uid", "text", 2).collect()}
    assert got == {1: (1, 3, 2), 2: (1, 3, 2), 3: (1, 3, 2), 8: (1, 3, 2), 5: (5, 2, 1), 6: (5, 2, 1), 7: (7, 1, 0), 9: (9, 2, 1), 10: (9, 2, 1)}
    forms = {r.block_uid: (r.look, r.fold) for r in lookalike.with_forms(df, "text").collect()}
    assert forms[2] == ("Box A", "box a") and forms[4] == (None, None) and forms[5] == ("", "") and forms[6] == ("", "")


# Noise of scanned pages

TITLE = "The Old Archive"


def test_scan_noise(spark):
    base = "the canal keeps a record because the contract lists every page"
    texts = [
        "the canal keeps a rec-\nord of every page",
        "the old well-\nknown reader has seen every page",
        f"{base} and a well-known reader and a well-known page",
        "the c0ntract lists every pagc of the reader",
        "THE OLD ARCHIVE\nthe canal keeps a record",
        "the canal keeps\n- 1 -\na record of every page",
        "the canal keeps\n1934\na record of every page",
        "12.50\n13.75\n",
        "KB-\n4369 lists every page",
        None, "", "the   canal",
        " ".join(["the contract lists every page"] * 3000),
    ]
    files = spark.createDataFrame([(1, TITLE), (2, None)], "doc_id long, title string")
    many = rows(spark, texts + [base] * 20)
    both = many.union(many.limit(4)).withColumn("n", F.lit("x")).withColumn("line", F.lit(0))
    got = {(r.row_uid, r.noise) for r in scannoise.found(both, files, lexicon(spark)).collect()}
    assert got == {(0, "hyphen"), (3, "misread"), (4, "header"), (5, "page_no")}
    fixed = {r.row_uid: r.repaired for r in scannoise.repaired(both, files, lexicon(spark)).collect()}
    assert len(fixed) == len(texts) + 20
    assert fixed[0] == "the canal keeps a record of every page" and fixed[1] == "the old well-known reader has seen every page"
    assert fixed[3] == "the contract lists every page of the reader" and fixed[4] == "the canal keeps a record" and fixed[5] == "the canal keeps a record of every page"
    assert fixed[7] == "12.50\n13.75" and fixed[9] is None and fixed[10] == "" and fixed[11] == "the   canal"


def test_misread_by_context(spark):
    """Capitalised words count with support from their neighbours, and of two forms the supported one is meant."""
    lex = spark.createDataFrame([("en", w, 1) for w in "the contract lists every page bear hear we can of".split()], "lang string, word string, freq long")
    texts = ["the contract lists every page"] * 30 + ["we can hear the page"] * 30 + ["the bear of the page"] * 40
    texts += ["Tbe contract lists every page", "we can 6ear the page", "Tbe Xyz", "every page of Hear"]
    got = {r.row_uid for r in scannoise.found(rows(spark, texts), spark.createDataFrame([], "doc_id long, title string"), lex).where("noise = 'misread'").collect()}
    assert {100, 101} <= got and 103 not in got
    fixed = {r.row_uid: r.repaired for r in scannoise.repaired(rows(spark, texts), spark.createDataFrame([], "doc_id long, title string"), lex).collect()}
    assert fixed[100] == "The contract lists every page" and fixed[101] == "we can hear the page"


def test_scan_noise_of_a_large_file(spark, monkeypatch):
    """A file that has most of all lines comes out the same when its lines are split among tasks."""
    from pagewright.functions.skew import split_join

    texts = [f"{TITLE.upper()}\nthe canal keeps a record\n{i + 40}\nof every page" for i in range(60)] + ["the old archive\nthe canal keeps\n7\na record"] * 3
    df = spark.createDataFrame([("blocks", i, 777 if i < 60 else i, i if i < 60 else 0, t) for i, t in enumerate(texts)], "tbl string, row_uid long, doc_id long, page_index int, text string")
    files = spark.createDataFrame([(777, TITLE), (60, "Another"), (61, None)], "doc_id long, title string")
    whole = {tuple(r) for r in scannoise.found(df, files, lexicon(spark)).collect()}
    monkeypatch.setattr(scannoise, "split_join", lambda *a, **k: split_join(*a, part_rows=7, **k))
    assert {tuple(r) for r in scannoise.found(df, files, lexicon(spark)).collect()} == whole
    assert {r[1] for r in whole if r[2] == "header"} == set(range(60)) and {r[1] for r in whole if r[2] == "page_no"} >= set(range(60))


@pytest.mark.parametrize("line, yes", [("xiv", True), ("- VII -", True), ("xiV", False), ("v", False), ("mix", False), ("dix.", False), ("12", False)])
def test_front_matter(line, yes):
    assert scannoise.is_front(line) is yes


def test_scan_noise_empty(spark):
    files = spark.createDataFrame([], "doc_id long, title string")
    assert scannoise.found(rows(spark, []), files, lexicon(spark)).count() == 0
    assert scannoise.repaired(rows(spark, []), files, lexicon(spark)).count() == 0


@pytest.mark.parametrize("line, n", [("- 13 -", 13), ("Page 3 of 9", 3), ("Seite 2 / 34", 2), ("[4]", 4), ("   7", 7), ("xiv", 14), ("p. 6", 6), ("Página 3 de 61", 3), ("12.50", None), ("3 kg", None), ("831 pages.", None), ("", None), ("mild", None)])
def test_page_numbers(line, n):
    assert scannoise.page_number(line) == n


@pytest.mark.parametrize(
    "read, meant, yes",
    [("c0ntract", "contract", True), ("rnargin", "margin", True), ("retums", "returns", True), ("clepot", "depot", True), ("coliimn", "column", True), ("cacbe", "cache", True), ("manuscnto", "manuscrito", True), ("varme", "vanne", True), ("railvvay", "railway", True), ("schedlue", "schedule", False), ("full", "flur", False), ("drawnig", "drawing", False), ("pal", "par", False)],
)
def test_confusable(read, meant, yes):
    assert scannoise.confusable(read, meant) is yes


# Splitting


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,\ń。x", max_size=900), st.integers(20, 120), st.integers(0, 15))
def test_pieces(text, limit, overlap):
    ps = splitting.pieces(text, limit, overlap)
    assert ps[0][0] == 0 and ps[-1][1] == len(text)
    assert all(0 < b - a <= limit or len(text) == 0 for a, b in ps)
    assert all(nxt[0] == b - overlap for (_, b), nxt in zip(ps, ps[1:], strict=False))
    assert text == text[: ps[0][1]] + "".join(text[b:c] for (_, b), (_, c) in zip(ps, ps[1:], strict=False))


def test_pieces_at_boundaries():
    text = "One sentence stands here. " * 3 + "\n\n" + "Another one is there. " * 3
    first = splitting.pieces(text, 90, 0)[0]
    assert text[: first[1]].endswith("\n\n")
    with pytest.raises(ValueError):
        splitting.pieces("x" * 10, 5, 5)


def test_split(spark):
    limits = spark.createDataFrame([("blocks", 50, 5)], "tbl string, max_size int, overlap_size int")
    texts = ["x" * 50, "word " * 40, None, "", "é" * 51, "z" * 100_000]
    df = rows(spark, texts)
    out = splitting.split(df.union(df).withColumn("piece", F.lit("c")), limits)
    assert {r.row_uid for r in splitting.above_limit(df, limits).collect()} == {1, 4, 5} == {r.row_uid for r in out.select("row_uid").distinct().collect()}
    assert out.agg(F.max(F.length("piece_text"))).first()[0] <= 50 and out.groupBy("row_uid", "piece").count().agg(F.max("count")).first()[0] == 1
    assert splitting.split(df.where("false"), limits).count() == 0


# Packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=80))
def test_best_two_fit(sizes):
    bins = packing.best_two_fit(sizes, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 40 for b in bins)
    assert sum(2 * sum(sizes[i] for i in b) <= 40 for b in bins) <= 1  # two that are half full would have been one


def test_pack(spark):
    r = np.random.default_rng(1)
    sizes = [0, 0, 5000, 512, *map(int, r.integers(1, 700, 2000))]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(0, 0, "x"), (None, 3, "y")], "doc_id long, n_tokens int, shard string")
    out = packing.pack(df, 512, shard_rows=500).toPandas()
    fill = out.groupby("container_id").n_tokens.sum()
    assert fill.max() <= 512 and fill.sum() == sum(sizes) + 3 and fill.sum() / (512 * len(fill)) > 0.98
    whole = out.groupby("doc_id").piece.count()
    assert all(whole[i] == max(1, -(-n // 512)) for i, n in enumerate(sizes))
    assert packing.pack(df.where("false"), 512).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def test_lengths(spark):
    import importlib.util

    if importlib.util.find_spec("tiktoken") is None:
        pytest.skip("no tokenizer")
    df = spark.createDataFrame([(1, "hello world", 7), (2, None, 7), (3, "", 7)], "doc_id long, text string, n_tokens int")
    assert {r.doc_id: r.n_tokens for r in with_lengths(df).collect()} == {1: 2, 2: 0, 3: 0}


# Mixing


def test_budgets(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 600), ("a", "fr", "x", 300), ("a", "fr", "y", 100), ("b", "en", "x", 50), ("c", "en", "x", 1000)], "source string, lang string, domain string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.25, 4), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    b = {(r.source, r.lang, r.domain): r.budget for r in mixing.budgets(leaves, targets, 1000).collect()}
    assert b["b", "en", "x"] == pytest.approx(100)  # all it can give
    assert sum(b.values()) == pytest.approx(1000)
    of_a = b["a", "en", "x"] + b["a", "fr", "x"] + b["a", "fr", "y"]
    assert of_a / b["c", "en", "x"] == pytest.approx(2) and b["a", "en", "x"] / (b["a", "fr", "x"] + b["a", "fr", "y"]) == pytest.approx(1.5) and b["a", "fr", "x"] / b["a", "fr", "y"] == pytest.approx(3)
    given = {"lang": spark.createDataFrame([("en", 0.0), ("fr", 1.0)], "lang string, weight double")}
    w = {(r.source, r.lang, r.domain): r.budget for r in mixing.budgets(leaves, targets, 1000, given).collect()}
    assert w["a", "fr", "x"] + w["a", "fr", "y"] == pytest.approx(400) and w["a", "en", "x"] == pytest.approx(of_a - 400)  # the shortage goes to the sibling
    assert sum(r.budget for r in mixing.budgets(leaves, targets, 10**9).collect()) == pytest.approx(1000 + 100 + 4000)  # no more than there is


def test_select(spark):
    r = np.random.default_rng(2)
    docs = [(i, ["web", "WEB ", "man-ual", "few"][i % 4] if i % 40 else None, ["en", "EN", None, "fr"][i % 4], int(n)) for i, n in enumerate(r.integers(0, 300, 6000))]
    docs = [d for d in docs if d[1] != "few" or d[0] < 200]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, source string, lang string, n_tokens int, times int")
    targets = spark.createDataFrame([("web", 0.5, 1), ("man_ual", 0.4, 3), ("few", 0.05, 4), ("none", 0.05, 4)], "source string, target_share double, max_repeats int")
    out = mixing.select(df, targets)
    s = {x.source: x for x in mixing.shares(out, targets).collect()}
    assert s["none"].tokens == 0 and all(x.most_times <= x.max_repeats for x in s.values())
    assert s["few"].most_times == 4 and s["web"].share / s["man_ual"].share == pytest.approx(1.25, abs=0.01)
    total = sum(d[3] for d in docs)
    assert sum(x.tokens for x in s.values()) == pytest.approx(total, rel=0.01)
    again = mixing.select(df, targets).exceptAll(out)
    assert again.count() == 0
    none = mixing.select(df.where("false"), targets)
    assert none.count() == 0 and {x.share for x in mixing.shares(none, targets).collect()} == {None}


def test_select_from_small_leaves(spark):
    """Rounding in thousands of leaves of a document or two doesn't add up."""
    r = np.random.default_rng(4)
    docs = [(i, "ab"[i % 2], "en", f"site-{int(r.integers(0, 900))}", int(n)) for i, n in enumerate(r.integers(1, 900, 3000))]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, site string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.7, 4), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    s = {x.source: x.share for x in mixing.shares(mixing.select(df, targets), targets).collect()}
    assert s["a"] == pytest.approx(0.7, abs=0.002) and s["b"] == pytest.approx(0.3, abs=0.002)


# Stuffed pages


def test_spam(spark):
    prose = "The canal keeps a record of every page that the reader has seen in the old archive. While a letter lists the region, the contract keeps the bridge near the water. "
    spam = ["paper tray, scanner, paper tray, scanner, toner, " * 20, "#scan #toner #tray " * 20, "[cheap toner](http://shop.x.test/a)\n" * 20, "Buy toner cheap toner best scanner. " * 20, "http://a.test/x " * 20, "tray of the toner and the scanner of a toner in the scanner with toner. " * 10]
    fair = [prose * 3, "\n".join(f"- {prose.strip()} http://a{i}.test/x" for i in range(8)), prose * 3 + "#a #b http://x.test", "", None, " ", "x", prose * 800]
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t in enumerate([*spam, *fair, *[prose * (1 + i % 4) for i in range(60)]])], "doc_id long, text string, lang string, spam double")
    got = {r.doc_id for r in stuffing.spam(docs.union(docs.limit(3)), lexicon(spark)).collect()}
    assert got == set(range(len(spam)))
    assert stuffing.spam(docs.where("false"), lexicon(spark)).count() == 0


def test_many_odd_words():
    """A long text of many different words takes no more than its length."""
    import time

    text = " ".join(f"w{chr(97 + i % 26)}q{i}z" for i in range(60_000))
    began = time.process_time()
    counts = scannoise._Counts(scannoise._Stock({"x": ["en"]}))
    got, numbers = scannoise._scan(text, 0, [100, 200], counts)
    assert len(numbers) == 60_000 and len(got) == 60_000 and time.process_time() - began < 15


# Long runs of one kind of character


@pytest.mark.parametrize("run", [" ", ".", "|", "-", "a.", "[", "<a ", "# ", "1", "l1", "\n", "\t", "('", "a-"])
def test_long_runs(run):
    """No pattern takes more than linear time, about."""
    import time

    text = "x" + run * 60_000 + "y"
    began = time.process_time()
    scannoise._scan(text, 0, [100, 200], scannoise._Counts(scannoise._Stock({"x": ["en"]})))
    stuffing.judge(text, stuffing.Lexicon([("en", "x")]))
    stuffing.counted(text, stuffing.Lexicon([("en", "x")]))
    splitting.pieces(text, 1500, 150)
    lookalike.look(text)
    word_hashes([text])
    assert time.process_time() - began < 15

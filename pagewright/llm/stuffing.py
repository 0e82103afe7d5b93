"""Keyword-stuffed and link-list pages.

Each page is read once and becomes its word counts: how often each word of the common stock
occurs, how many other words, numbers, words of links and tags there are, and its spectrum (how many words
occur how often). In SQL, over all pages:

* windows over the spectrum give each frequency its rank; the slope and the residual of the
  line through log frequency over log rank describe the page's rank-frequency curve;
* the page's distribution over the words is compared (Kullback-Leibler divergence) with that of the
  prose of its language;
* a page is flagged if slope, residual or divergence is extreme for pages of the same language and
  comparable length. What is usual is learnt twice: from all pages, by medians and quartiles, then from
  those that weren't extreme, so that spam doesn't set the measure, and no other count chooses the prose.

Flagged pages are read again, whole: of those the ones are spam in which more than half of the words
belong to repeated keywords, links, tags or attributes. Pages that aren't flagged never get there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions.scratch import written
from pagewright.functions.tables import once

# What begins or is a link, a tag, an attribute.
URL = r"(?:https?://|www\.)[^\s<>()\[\]\"']+|(?<![\w@.-])(?:[\w-]+\.)+(?:com|org|net|info|biz|io|example|test|invalid|[a-z]{2})(?:/[^\s<>()\[\]\"']*)?(?![\w.-])"
ANCHOR = r"\[[^\[\]\n]*\]\([^()\s]*\)|<a\b[^<>\n]*>[^<\n]*</a>"
TAG = r"(?<!\w)[#@][^\W\d_][\w-]*"
_URL, _ANCHOR, _TAG = re.compile(URL, re.I), re.compile(ANCHOR, re.I), re.compile(TAG)
_HTML = re.compile(r"<[^<>\n]+>")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_LIST = re.compile(r"\s*[,|;/•·–>]\s*|\s{2,}|\t")
_MAYBE_LINK, _TARGET, _DIGIT = re.compile(r"\.[A-Za-z]"), re.compile(r"\]\([^)]*\)"), re.compile(r"\d")
_LEET = str.maketrans("013457", "oleast")
#: What isn't a word of the common stock, before the words in a page's distribution.
LINK, TAGGED, NUMBER, OTHER = range(4)
#: How far from what is usual is extreme: slope and residual, in robust deviations; divergence, in nats above the median.
REACH, EXCESS = 4.0, 0.25
#: Fewer pages of one language and length than this say nothing: the measure is then that of the length in any language.
FEW = 20
#: The language of a page without any common word: it is measured by the prose of all languages.
ANY = "?"

PAGES = "doc_id long, lang string, words long, ids array<int>, ns array<int>, spectrum array<struct<f:int,k:int>>"


class Lexicon:
    """Words of the languages; `small` are those of up to three letters."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.langs: dict[str, set[str]] = {}
        for lang, word in rows:
            self.langs.setdefault(word, set()).add(lang)
        self.small = {w for w in self.langs if len(w) <= 3}
        self.ids = {w: OTHER + 1 + i for i, w in enumerate(sorted(self.langs))}


def _content(words: list[str], low: list[str], known: dict) -> tuple[list[str], float]:
    """(words of content, how many of them a sentence may have): those of the common stock, and by half those that may be
    names as they have a capital."""
    content, good = [], 0.0
    for w, x in zip(words, low, strict=True):
        if len(x) > 3 and (x in known or x.isalpha() or not _DIGIT.search(x)):
            content.append(x)
            if x in known:
                good += 1
            elif w[0] != x[0] and not w.isupper():
                good += 0.5
    return content, good


def _loose(w: str) -> str:
    """A word without the disguises of spam: digits for letters, numbers at its ends."""
    return w if w.isalpha() else w.translate(_LEET).strip("0123456789")


def _without_links(text: str) -> tuple[str, int, int, int]:
    """(the text without links and tags, words of links with their anchor texts, words of bare links, tags). An anchor
    text holds no bracket."""
    named = bare = tags = 0
    if _MAYBE_LINK.search(text) or "](" in text or "<" in text:
        if "](" in text or "<" in text:
            for m in _ANCHOR.finditer(text):
                named += len(_WORD.findall(m[0]))
            if named:
                text = _ANCHOR.sub(" ", text)

        def link(m: re.Match) -> str:
            nonlocal bare
            bare += len(_WORD.findall(m[0]))
            return " "

        text = _URL.sub(link, text)
        if "<" in text:
            text = _HTML.sub(" ", text)
    if "#" in text or "@" in text:
        text, tags = _TAG.subn(" ", text)
    return text, named, bare, tags


def counted(text: str, lex: Lexicon) -> tuple[str, int, dict[int, int], list[tuple[int, int]]]:
    """(language, words, how many of each kind or common word, spectrum) of a page."""
    rest, named, bare, tags = _without_links(text)
    counts = Counter(map(str.lower, _WORD.findall(rest)))
    dist: Counter = Counter()
    votes: Counter = Counter()
    for w, n in counts.items():
        i = lex.ids.get(w)
        if i is None:
            dist[NUMBER if w[0].isdigit() else OTHER] += n
        else:
            dist[i] += n
            for x in lex.langs[w]:
                votes[x] += n
    if named + bare:
        dist[LINK] = named + bare
    if tags:
        dist[TAGGED] = tags
    spectrum = Counter(counts.values())
    for n in (named + bare, tags):  # as words that are repeated
        if n:
            spectrum[n] += 1
    lang = max(votes.items(), key=lambda x: (x[1], x[0]))[0] if votes else ANY
    return lang, sum(dist.values()), dist, sorted(spectrum.items(), reverse=True)


def judge(text: str, lex: Lexicon) -> tuple[int, int]:
    """(words, words that belong to no sentence) of a page."""
    known, small = lex.langs, lex.small
    read = []
    for line in text.splitlines():
        rest, *links = _without_links(line)
        parts = []
        for part in _SENTENCE.split(rest):
            ws = _WORD.findall(part)
            if ws:
                parts.append((part, ws, [w.lower() for w in ws]))
        if parts or any(links):
            read.append((parts, *links))
    # first, each part by itself: a list of short items; a sentence, bound by small words, most content common, little of it repeated
    loose: Counter = Counter()
    judged = []
    for parts, *links in read:
        row = []
        for part, ws, low in parts:
            bound = not small.isdisjoint(low)
            content, good = _content(ws, low, known)
            listed = False
            if len(ws) >= 4:
                items = [i for i in _LIST.split(part.strip()) if i]
                listed = len(items) >= 4 and len(ws) <= 3 * len(items)
            prose = bound and bool(content) and not listed and good >= 0.5 * len(content) and not (len(content) >= 4 and len(set(content)) <= 0.6 * len(content))
            if not prose:
                loose.update(_loose(x) for x in low if len(x) > 2)
            row.append((len(ws), low, content, bound, listed, prose))
        judged.append((row, *links))
    # then by what is repeated in parts that are no sentences: those words are the page's keywords
    keywords = {w for w, n in loose.items() if n >= 3 and len(w) > 3 or n >= 3 and w and w not in small}
    sums = []
    for row, named, bare, tags in judged:
        sentence_words = keyword_words = 0
        for n, low, content, bound, listed, prose in row:
            if prose:
                stuffed = bool(keywords) and sum(_loose(x) in keywords for x in content) >= 0.6 * len(content)
            else:
                stuffed = listed or bool(named or bare) or n >= 4 and not bound or any(_loose(x) in keywords for x in low)
            if stuffed:
                keyword_words += n
            else:
                sentence_words += n
        sums.append((sentence_words, keyword_words, named, bare, tags, len(row)))
    # a list of readings, whose links come with sentences, is no spam; among links that don't, one sentence is a link's text
    linked = [x for x in sums if x[2] or x[3]]
    lone = sum(x[0] < 4 for x in linked)
    readings = lone < 0.2 * len(linked)
    spam = words = 0
    for sentence_words, keyword_words, named, bare, tags, parts in sums:
        words += sentence_words + keyword_words + named + bare + tags
        spam += keyword_words + named + tags + (0 if readings and sentence_words >= 4 else bare)
        if not readings and bare and parts == 1:
            spam += sentence_words
    return words, min(spam, words)


def _lexicon(lexicon: DataFrame) -> Lexicon:
    """The lexicon is a small table of fixed size."""
    return Lexicon([(r.lang, r.word) for r in lexicon.where("word is not null").select("lang", "word").distinct().collect()])


def pages(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """doc_id, text -> the word counts of each page with text; a page without words has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                lang, words, dist, spectrum = counted(text, lex)
                if words:
                    out.append((doc, lang, words, list(dist), list(dist.values()), [{"f": f, "k": k} for f, k in spectrum]))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "words", "ids", "ns", "spectrum"])

    return docs.where(F.length("text") > 0).select("doc_id", "text").mapInPandas(run, PAGES)


def curves(read: DataFrame) -> DataFrame:
    """doc_id, slope and residual of the rank-frequency curve; a page whose words all occur equally often is flat."""
    s = read.select("doc_id", F.explode("spectrum").alias("s")).select("doc_id", "s.f", "s.k")
    w = Window.partitionBy("doc_id").orderBy(F.desc("f"))
    s = s.withColumn("last", F.sum("k").over(w)).withColumn("x", F.log(F.col("last") - (F.col("k") - 1) / 2)).withColumn("y", F.log("f"))
    left = F.regr_syy("y", "x") * (1 - F.coalesce(F.regr_r2("y", "x"), F.lit(1.0))) / F.count("*")
    return s.groupBy("doc_id").agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.coalesce(F.sqrt(F.greatest(left, F.lit(0.0))), F.lit(0.0)).alias("residual"))


def _distributions(prose: DataFrame, size: int) -> DataFrame:
    """lang, norm: the share of each kind and word in the prose of a language, and of all languages (ANY). A row a
    language of the lexicon, of `size` numbers each."""
    got = prose.select("lang", F.explode(F.arrays_zip("ids", "ns")).alias("x")).groupBy("lang", "x.ids").agg(F.sum("x.ns").alias("n")).collect()
    sums: dict[str, list[float]] = {ANY: [0.5] * size}
    for r in got:
        for lang in {r.lang, ANY}:
            sums.setdefault(lang, [0.5] * size)[r.ids] += r.n
    return prose.sparkSession.createDataFrame([(k, [x / sum(v) for x in v]) for k, v in sums.items()], "lang string, norm array<double>")


def _diverged(read: DataFrame, norms: DataFrame) -> DataFrame:
    """Adds the divergence of each page from its language's prose."""
    known = [r.lang for r in norms.select("lang").collect()]
    d = read.withColumn("_of", F.when(F.col("lang").isin(known), F.col("lang")).otherwise(ANY)).join(F.broadcast(norms.withColumnRenamed("lang", "_of")), "_of")
    term = lambda acc, x: acc + x["ns"] / F.col("words") * F.log(x["ns"] / F.col("words") / F.get("norm", x["ids"]))
    return d.withColumn("divergence", F.aggregate(F.arrays_zip("ids", "ns"), F.lit(0.0), term)).drop("norm", "_of")


MEASURES = ("slope", "residual", "divergence")


def _measures(prose: DataFrame) -> list[tuple]:
    """lang, size, slope, residual, divergence: quartiles of the pages of each language and length, of each length (lang null),
    and of all (both null). The rows are as few as languages times powers of two, and are gathered."""
    what = [F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in MEASURES]
    by = prose.where(F.col("lang") != ANY)
    got = by.groupingSets([["lang", "size"], ["size"], []], "lang", "size").agg(*what, F.count("*").alias("pages")).where((F.col("pages") >= FEW) | F.col("size").isNull() & (F.col("pages") > 0))
    return [tuple(r) for r in got.select("lang", "size", *MEASURES).collect()]


def _judged(d: DataFrame, measures: list[tuple]) -> DataFrame:
    """Adds whether slope, residual and divergence are extreme for the page's language and length."""
    spark, kinds = d.sparkSession, ", ".join(f"{x} array<double>" for x in MEASURES)
    own = spark.createDataFrame([r for r in measures if r[0] is not None], f"lang string, size int, {kinds}").select("lang", "size", F.struct(*MEASURES).alias("own"))
    same = spark.createDataFrame([r[1:] for r in measures if r[0] is None and r[1] is not None], f"size int, {kinds}").select("size", F.struct(*MEASURES).alias("same"))
    of_all = next((r[2:] for r in measures if r[1] is None), None)
    every = F.lit(None) if of_all is None else F.struct(*[F.array(*map(F.lit, q)).alias(x) for x, q in zip(MEASURES, of_all, strict=True)])
    j = d.join(F.broadcast(own), ["lang", "size"], "left").join(F.broadcast(same), "size", "left").withColumn("usual", F.coalesce("own", "same", every))

    def far(x: str) -> Column:
        q = F.col(f"usual.{x}")
        return F.coalesce(F.abs(F.col(x) - q[1]) > REACH * F.greatest(q[2] - q[0], F.lit(1e-6)) / 1.35, F.lit(True))

    over = F.col("divergence") - F.col("usual.divergence")[1]
    j = j.withColumn("far_slope", far("slope")).withColumn("far_residual", far("residual")).withColumn("diverges", F.coalesce(over > EXCESS, F.lit(True)))
    return j.withColumn("flagged", F.col("far_slope") | F.col("far_residual") | F.col("diverges")).drop("own", "same", "usual")


def scored(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, lang, words, slope, residual, divergence, which of them are extreme, and whether the page is flagged.

    Null, empty and wordless texts have no row; a doc_id that is repeated is one page; further columns are ignored. A page
    without a common word is measured by the prose of all languages, and where there is no prose at all every page is flagged."""
    lex = _lexicon(lexicon)
    read = written(pages(once(docs.select("doc_id", "text"), "doc_id"), lex), "pages")
    wide = OTHER + 1 + len(lex.ids)
    size = F.least(F.floor(F.log2("words")), F.lit(30)).cast("int")
    base = _diverged(read.drop("spectrum"), _distributions(read, wide)).join(curves(read), "doc_id").withColumn("size", size)
    base = written(base, "curves")
    first = _judged(base, _measures(base))
    again = _diverged(first.drop("divergence"), _distributions(first.where("not flagged"), wide))
    kept = written(again.select("doc_id", "lang", "size", "words", *MEASURES, "flagged"), "divergence")
    out = _judged(kept.drop("flagged"), _measures(kept.where("not flagged")))
    return out.select("doc_id", "lang", "words", *MEASURES, "far_slope", "far_residual", "diverges", "flagged")


#: Flagged pages that are broadcast at most (8 bytes each); beyond it their join is shuffled.
BROADCAST_IDS = 1_000_000


def spam(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id of spam pages: flagged ones of whose words more than half belong to no sentence. Null and empty texts are
    none; a doc_id that is repeated comes out once; further columns are ignored."""
    lex = _lexicon(lexicon)
    flagged = written(scored(docs, lexicon).where("flagged").select("doc_id").distinct(), "flagged")
    ids = F.broadcast(flagged) if flagged.count() <= BROADCAST_IDS else flagged

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = []
            for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                words, stuffed = judge(text, lex)
                if 2 * stuffed > words:
                    hits.append(doc)
            yield pd.DataFrame({"doc_id": pd.array(hits, "Int64")})

    texts = docs.where(F.length("text") > 0).select("doc_id", "text").join(ids, "doc_id")
    return texts.mapInPandas(run, "doc_id long").distinct()

"""Noise of scanned pages in text: cut words, misread letters, running headers, page numbers.

Each text is read once (Arrow batches) and turned into small events: cuts at line
ends, lines that may be headers or page numbers, words outside the lexicon, counts of
known words and of hyphenated compounds. Whatever needs the whole corpus then happens
on events in SQL:

* misread words: words are grouped by a skeleton, the strokes they are made of; within a
  group and the language of the text around, a rare form is a misreading of a much more frequent
  one from which it differs by glyphs that look alike, place by place. Of several such forms the one is
  meant that the words before and after support most often, counted over all texts; a word with a
  capital, which may be a name, is a misreading only with such support, a neighbour at each place on average;
* headers: lines whose letters, digits masked, are those of the file's title;
* page numbers: lines of nothing but a number, in the offset usual in their file, or of a Roman
  numeral, as front matter is numbered by itself;
* cuts: a mark of division at a line end, unless the parts are a compound that is
  written with a hyphen within lines elsewhere.

`repaired` drops headers and page numbers, joins lines into paragraphs with SQL windows
and puts the chosen forms in place of misread words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagewright.functions.scratch import written
from pagewright.functions.skew import split_join
from pagewright.functions.strings import strip
from pagewright.functions.tables import once

# Marks of division at a line end; ornaments about page numbers; words for "page" and "of".
MARKS = "-‐‑¬­"
ORNAMENTS = "-‐‑‒–—*~|.·•[](){}<>=_ \t"
PAGE_WORDS = "page|pag|pg|p|seite|s|página|pág|pagina|folio|blatt|hoja|feuillet"
OF_WORDS = "of|sur|von|de|di|/|\\|"
# Glyphs that scanners take for one another, each as its strokes. I is a single upright stroke.
STROKES = {
    "0": "o", "1": "I", "|": "I", "l": "I", "i": "I", "r": "I", "n": "II", "u": "II", "m": "III", "5": "s", "6": "b",
    "h": "b", "9": "g", "e": "c", "d": "cI", "w": "vv", "t": "f", "8": "B", "2": "z",
}

# Single glyphs that look alike, as one of them; groups of glyphs that look like others, in those terms.
ALIKE = {"0": "o", "1": "i", "|": "i", "l": "i", "5": "s", "6": "b", "h": "b", "9": "g", "e": "c", "t": "f", "8": "B", "2": "z"}
GROUPS = [("m", "rn"), ("d", "ci"), ("w", "vv"), ("u", "ii"), ("n", "ri"), ("nn", "rm")]

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
_BREAK = re.compile(LINE_BREAK)
_WORD = re.compile(r"[^\W_|]*(?:\|[^\W_|]*)*")
_TOKEN = re.compile(r"[^\W_|]+(?:\|+[^\W_|]*)*|(?<!\|)\|+[^\W\d_|]+(?:\|+[^\W_|]*)*")
_PLAIN = re.compile(r"[^\W_]+")  # the tokens of a text without bars
_COMPOUND = re.compile(r"(?<![\w-])[^\W\d_]+(?:-[^\W\d_]+)+(?![\w-])")
_ROMAN = r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_PAGE_LINE = re.compile(rf"(?:(?:{PAGE_WORDS})\b\.?\s*)?(?:nr\.?|no\.?|n°)?\s*(?P<n>\d{{1,6}}|(?=[mdclxvi]){_ROMAN})(?:\s*(?:{OF_WORDS})\s*(?:\d{{1,6}}|(?=[mdclxvi]){_ROMAN}))?", re.I)
_EDGE_NUMBER = re.compile(r"\W*\d{1,6}\W+")
_DIGIT_OR_BAR = re.compile(r"[\d|]")
_HAS_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTER, _NO_GLYPH = re.compile(r"[\W\d_]+"), re.compile(r"[^\w|]+|_+")
_ALIKE = str.maketrans(ALIKE)
_SKELETON = str.maketrans({k: v for k, v in STROKES.items() if len(v) == 1})
_WIDER = [(k, v) for k, v in STROKES.items() if len(v) > 1]
_NO_ASCII_LETTER = bytes(i for i in range(128) if not chr(i).isalpha())
_NO_ASCII_GLYPH = bytes(i for i in range(128) if not chr(i).isalnum() and chr(i) != "|")
_FRONT = re.compile(r"[ivxl]{2,}|[IVXL]{2,}")
#: A line longer than this, its runs of spaces one, is no page number: the longest word, numeral, word and numeral are shorter.
_LONGEST = 60

#: Between a cut word and its rest stand at most a header and a line of the page's own, so the rest begins one of the next lines
#: that hold text and are no page number.
LINES_TO_REST = 3
#: Times a word outside the lexicon must occur to be a form that others are misread for; times a compound must be written with its
#: hyphen within lines to keep it at a line end.
FREQUENT, COMPOUND = 8, 2
#: How many times as often as the misreading the form meant occurs: for words with digits or bars, from four letters on, shorter ones.
RATIOS = (1, 5, 20)
#: Pairs of known words counted in a task before they are passed on.
_PAIRS = 1_000_000
#: Misread words that are broadcast at most; beyond it their join is shuffled.
BROADCAST_WORDS = 500_000

#: The language of a text without a known word: its words are compared with those of all languages.
ANY = "?"
EVENTS = "kind string, tbl string, row_uid long, doc_id long, line int, lang string, a string, keys array<string>, n long"


def skeleton(word: str) -> str:
    """The word's strokes; words that scanners confuse have the same."""
    word = word.translate(_SKELETON)
    for glyph, strokes in _WIDER:  # none of which is a glyph of the table itself
        word = word.replace(glyph, strokes)
    return word


def confusable(read: str, meant: str) -> bool:
    """Whether one word is the other with glyphs, or groups of them, replaced by ones that look alike, place by place."""
    a, b = read.translate(_ALIKE), meant.translate(_ALIKE)
    rules = [*GROUPS, *((y, x) for x, y in GROUPS)]
    reach = [{0}] + [set() for _ in range(len(a))]  # places in b that each place in a can meet
    for i in range(len(a) + 1):
        for j in sorted(reach[i]):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                reach[i + 1].add(j + 1)
            for x, y in rules:
                if a.startswith(x, i) and b.startswith(y, j):
                    reach[i + len(x)].add(j + len(y))
    return len(b) in reach[len(a)]


def roman(s: str) -> int:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    x = [value[c] for c in s.lower()]
    return sum(-a if a < b else a for a, b in zip(x, [*x[1:], 0], strict=True))


def page_number(line: str) -> int | None:
    """The number of a line that holds nothing but a page number, else None."""
    s = line.strip().strip(ORNAMENTS)
    if len(s) > _LONGEST:
        s = " ".join(s.split())
    m = _PAGE_LINE.fullmatch(s) if 0 < len(s) <= _LONGEST else None
    if not m or m["n"].lower() in ("", "d", "c", "m", "l") and not m["n"].isdigit():
        return None
    return int(m["n"]) if m["n"].isdigit() else roman(m["n"])


def is_front(line: str) -> bool:
    """Whether the line is a page number of front matter: a small Roman numeral of several letters and one case."""
    return bool(_FRONT.fullmatch(line.strip().strip(ORNAMENTS)))


def letters(s: str) -> str:
    """Its letters alone, in one typography: digits, spaces and ornaments are masked."""
    return s.lower().encode().translate(None, _NO_ASCII_LETTER).decode() if s.isascii() else _NO_LETTER.sub("", unicodedata.normalize("NFKC", s).casefold())


def header_keys(line: str, longest: list[int] | None = None) -> list[str]:
    """What a line is compared with a title by: its letters, and the strokes of what is between page numbers. longest: the
    lengths above which a key can be no title's; such keys are left out, and not made where it shows before."""
    plain = letters(line)
    if longest and len(plain) >= max(longest):  # the strokes of as many letters are longer still
        return []
    first, last = _EDGE_NUMBER.match(line), _EDGE_NUMBER.match(line[::-1])
    a, b = first.end() if first else 0, len(line) - (last.end() if last else 0)
    inner = line[a:b] if a < b else line
    inner = inner.lower().encode().translate(None, _NO_ASCII_GLYPH).decode() if inner.isascii() else _NO_GLYPH.sub("", unicodedata.normalize("NFKC", inner).casefold())
    if longest is None:
        return [plain, "~" + skeleton(inner)]
    keys = [plain] if 3 < len(plain) <= longest[0] else []
    if len(inner) < longest[1]:  # strokes are never fewer than glyphs
        strokes = "~" + skeleton(inner)
        if 3 < len(strokes) <= longest[1]:
            keys.append(strokes)
    return keys


def _continuation(lines: list[str], i: int) -> list[str]:
    """First words of the next lines that hold text and are no page number: where a word cut at the end of line i may go on."""
    out = []
    for j in range(i + 1, len(lines)):
        s = lines[j].lstrip()
        if s and page_number(s) is None:
            out.append(_WORD.match(s)[0])
            if len(out) == LINES_TO_REST:
                break
    return out


def _last_word(line: str, end: int) -> str:
    """The word that ends there."""
    i = end
    while i and (line[i - 1].isalnum() or line[i - 1] == "|"):
        i -= 1
    return line[i:end]


def _kind_of(w: str, confused: frozenset[str]) -> str | None:
    """Of a word outside the lexicon: 'word' if it may be misread, 'name' if it may be but begins with a capital,
    None if it is a code, an abbreviation, or a name that has no look-alike in the lexicon."""
    glyphs = _DIGIT_OR_BAR.search(w)
    if w.islower() or glyphs and any(c.islower() for c in w) and not any(c.isupper() for c in w[1:]):
        return "word"
    if glyphs or w.isupper() or not w[0].isupper() or any(c.isupper() for c in w[1:]):
        return None
    return "name" if skeleton(w.lower()) in confused else None


def _apart(text: str, a: int, b: int, glyphs) -> bool:
    """Whether text[a:b] stands as a word: not within a path, an address or a formula."""
    before, after = text[a - 1 : a] if a else "", text[b : b + 1]
    return not (before and (before.isalnum() or before in "(/+@|") or after and (after.isalnum() or after in "/+@=|") or glyphs and before == "-")


def _standing(text: str, words: list[str], token: re.Pattern) -> list[str]:
    """Those words that stand as such somewhere. A few are looked for one by one, many in one pass, so that a long text of many
    words takes no more than its length."""
    if len(words) > 8:
        open_ = set(words)
        for m in token.finditer(text):
            if m[0] in open_ and _apart(text, m.start(), m.end(), _DIGIT_OR_BAR.search(m[0])):
                open_.discard(m[0])
                if not open_:
                    break
        return [w for w in words if w not in open_]
    out = []
    for w in words:
        glyphs, at = _DIGIT_OR_BAR.search(w), text.find(w)
        while at >= 0:
            if _apart(text, at, at + len(w), glyphs):
                out.append(w)
                break
            at = text.find(w, at + 1)
    return out


def _beside(times: dict[str, int], tokens: list[str], numbers: list[int], words: list[str]) -> dict[str, set[str]]:
    """The known words before and after each of some words, at all its places; found as above."""
    keys: dict[str, set[str]] = {w: set() for w in times}
    if len(times) > 8:
        places = [(i, w) for i, w in enumerate(tokens) if w in times]
    else:
        places = []
        for w, n in times.items():
            i = -1
            for _ in range(n):
                i = tokens.index(w, i + 1)
                places.append((i, w))
    for i, w in places:
        if i and numbers[i - 1]:
            keys[w].add("<" + words[numbers[i - 1]])
        if i + 1 < len(numbers) and numbers[i + 1]:
            keys[w].add(">" + words[numbers[i + 1]])
    return keys


class _Stock(dict):
    """Known words as they stand in texts -> their number from 1 on; 0 for others."""

    def __init__(self, known: dict[str, list[str]]) -> None:
        self.words = ["", *sorted(known)]
        self.number = {w: i for i, w in enumerate(self.words) if i}
        self.langs = sorted({x for v in known.values() for x in v}, reverse=True)  # of equal votes the last name's win
        self.votes = np.zeros((len(self.words), len(self.langs)), np.int32)
        for w, v in known.items():
            for x in v:
                self.votes[self.number[w], self.langs.index(x)] = 1
        self.confused = frozenset(map(skeleton, known))
        self.kinds: dict[str, str | None] = {}

    def __missing__(self, w: str) -> int:
        n = self.number.get(w.lower(), 0)
        if n or len(self) < 500_000:
            self[w] = n
        return n

    def kind(self, w: str) -> str | None:
        if w not in self.kinds:
            if len(self.kinds) > 200_000:
                self.kinds.clear()
            self.kinds[w] = _kind_of(w, self.confused)
        return self.kinds[w]


class _Counts:
    """What a task counts over its texts: known words, pairs of them that follow one another, compounds."""

    def __init__(self, stock: _Stock) -> None:
        self.stock = stock
        self.known = np.zeros(len(stock.words), np.int64)
        self.pairs: Counter = Counter()
        self.compounds: Counter = Counter()

    def languages(self, numbers: list[int], ends: list[int]) -> list[str]:
        """Counts a batch's words, laid end to end, and gives each text's language."""
        if not numbers:
            return [ANY] * len(ends)
        n, size = np.array(numbers), len(self.stock.words)
        self.known += np.bincount(n, minlength=size)
        last = np.zeros(len(n), bool)
        last[np.array(ends)[np.array(ends) > 0] - 1] = True
        both = np.flatnonzero((n[:-1] > 0) & (n[1:] > 0) & ~last[:-1])
        for code, k in zip(*np.unique(n[both] * size + n[both + 1], return_counts=True), strict=True):
            self.pairs[int(code)] += int(k)
        sums = np.concatenate([np.zeros((1, len(self.stock.langs)), np.int64), np.cumsum(self.stock.votes[n], axis=0)])
        e = np.array(ends)
        votes = sums[e] - sums[np.r_[0, e[:-1]]]
        return [self.stock.langs[i] if v else ANY for i, v in zip(votes.argmax(axis=1), votes.max(axis=1), strict=True)]

    def pair_rows(self) -> list[tuple]:
        words, size = self.stock.words, len(self.stock.words)
        rows = [("pair", None, None, None, None, None, words[c // size], [words[c % size]], n) for c, n in self.pairs.items()]
        self.pairs.clear()
        return rows

    def rows(self) -> list[tuple]:
        rows = [("known", None, None, None, None, None, self.stock.words[i], None, int(self.known[i])) for i in np.flatnonzero(self.known) if i]
        return rows + self.pair_rows() + [("compound", None, None, None, None, None, skeleton(w), None, n) for w, n in self.compounds.items()]


def _scan(text: str, page_index: int | None, longest: list[int], counts: _Counts) -> tuple[list[tuple], list[int]]:
    """(events as (kind, line, a, keys, n), numbers of the words) of one text. longest: the lengths of the longest title's
    keys, as no longer line can be a header."""
    stock = counts.stock
    lines = _BREAK.split(text)
    found: list[tuple] = []
    fragments: list[str] = []
    joined: set[str] = set()
    if len(lines) > 1:
        for i, line in enumerate(lines):
            if not line.strip():
                continue
            n = page_number(line)
            if n is not None:
                found.append(("page", i, "front" if is_front(line) else None, None, n - (page_index or 0)))
            else:
                keys = header_keys(line, longest)
                if keys:
                    found.append(("line", i, None, keys, None))
            end = line.rstrip(" \t")
            last = _last_word(end, len(end) - 1) if end[-1] in MARKS and i + 1 < len(lines) else ""
            if last and _HAS_LETTER.search(last):
                after = _continuation(lines, i)
                go_on = [w for w in after if w and (w[0].islower() or not w[0].isalpha() and not w.isdigit())]
                if go_on:
                    found.append(("cut", i, (last + go_on[0]).lower(), [skeleton(f"{last}-{w}".lower()) for w in go_on], None))
                    # another line's word may be the rest too, if headers lie between; a word of some length is no mere rest
                    fragments += [last, go_on[0], *(w for w in after if w != go_on[0] and len(w) < 6)]
                    joined.add((last + go_on[0]).lower())
    token = _TOKEN if "|" in text else _PLAIN
    tokens = token.findall(text)
    numbers = list(map(stock.__getitem__, tokens))
    seen = Counter([w for w, n in zip(tokens, numbers, strict=True) if not n] if 0 in numbers else ())
    maybe = {}
    if seen:
        dropped = Counter(fragments)
        for w, k in seen.items():
            if not w.isdigit() and dropped[w] < k:
                kind = stock.kind(w)
                if kind:
                    maybe[w] = kind
    if maybe:  # one place where a word stands as such is enough; all its places tell what is about it
        stands = _standing(text, list(maybe), token)
        beside = _beside({w: seen[w] for w in stands}, tokens, numbers, stock.words)
        found += [(maybe[w], None, w.lower(), sorted(beside[w]), seen[w]) for w in stands]
    if "-" in text:
        counts.compounds.update(m.lower() for t in text.split() if "-" in t for m in _COMPOUND.findall(t))
    found += [("word", None, w, None, max(1, seen[w])) for w in joined if w not in stock.number and w not in maybe]
    return found, numbers


@F.pandas_udf(T.StringType())
def _skeleton_of(s: pd.Series) -> pd.Series:
    return s.map(skeleton, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def _confusable(read: pd.Series, meant: pd.Series) -> pd.Series:
    return pd.Series([confusable(a, b) for a, b in zip(read, meant, strict=True)], index=read.index, dtype=bool)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys_of(s: pd.Series) -> pd.Series:
    return s.map(header_keys, na_action="ignore")


def events(texts: DataFrame, lexicon: DataFrame, files: DataFrame) -> DataFrame:
    """tbl, row_uid, doc_id, page_index, text -> events. The lexicon is a small table of fixed size; of the files only the
    greatest lengths of their titles' keys are gathered."""
    title_keys = files.where("title is not null").select(_keys_of("title").alias("k"))
    most = title_keys.agg(F.max(F.length(F.col("k")[0])).alias("a"), F.max(F.length(F.col("k")[1])).alias("b")).first()
    longest = [most.a or 0, most.b or 0]
    known: dict[str, list[str]] = {}
    for r in lexicon.where("word is not null").select("lang", "word").distinct().collect():
        known.setdefault(r.word, []).append(r.lang)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _Counts(_Stock(known))
        for pdf in batches:
            out, numbers, ends = [], [], []
            for tbl, uid, doc, page, text in zip(pdf.tbl, pdf.row_uid, pdf.doc_id, pdf.page_index, pdf.text, strict=True):
                got, ns = _scan(text, None if pd.isna(page) else int(page), longest, counts)
                key = tbl, uid, None if pd.isna(doc) else int(doc), len(ends)
                out += [(key, *x) for x in got]
                numbers += ns
                ends.append(len(numbers))
            langs = counts.languages(numbers, ends)
            rows = [(kind, tbl, uid, doc, line, langs[at], a, keys, n) for (tbl, uid, doc, at), kind, line, a, keys, n in out]
            if len(counts.pairs) > _PAIRS:
                rows += counts.pair_rows()
            if rows:
                yield _frame(rows)
        yield _frame(counts.rows())

    return texts.where(F.length("text") > 0).select("tbl", "row_uid", "doc_id", "page_index", "text").mapInPandas(run, EVENTS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])
    for c in ("row_uid", "doc_id", "line", "n"):
        pdf[c] = pdf[c].astype("Int64")
    return pdf


def misreadings(ev: DataFrame, lexicon: DataFrame) -> DataFrame:
    """kind ('word' or 'name'), lang, a (word as read), form (the word meant)."""
    words = ev.where("kind in ('word', 'name')").groupBy("kind", "lang", "a").agg(F.sum("n").alias("n"))
    listed = lexicon.where("word is not null").select("lang", F.col("word").alias("a")).distinct()
    listed = listed.unionByName(listed.select(F.lit(ANY).alias("lang"), "a").distinct())
    known = listed.join(F.broadcast(ev.where("kind = 'known'").groupBy("a").agg(F.sum("n").alias("n"))), "a")  # at most the lexicon's words
    forms = words.withColumn("listed", F.lit(False)).unionByName(known.select(F.lit("known").alias("kind"), "lang", "a", "n", F.lit(True).alias("listed")))
    forms = forms.withColumn("skeleton", _skeleton_of("a")).withColumn("clean", ~F.col("a").rlike(r"[0-9|]"))
    frequent = forms.where(F.col("clean") & (F.col("listed") | (F.col("kind") == "word") & (F.col("n") >= FREQUENT))).select("lang", "skeleton", F.col("a").alias("form"), F.col("n").alias("form_n"), F.col("listed").alias("form_listed"))
    rare = forms.where("not listed and (length(a) >= 3 or not clean)").join(frequent, ["lang", "skeleton"]).where("a != form and (form_listed or kind = 'word')")
    ratio = F.when(~F.col("clean"), RATIOS[0]).when(F.length("a") >= 4, RATIOS[1]).otherwise(RATIOS[2])
    rare = rare.where(F.col("form_n") >= F.col("n") * ratio).where(_confusable("a", "form")).select("kind", "lang", "a", "n", "form", "form_n")
    rare = written(rare, "rare")
    pairs = ev.where("kind = 'pair'").groupBy("a", F.col("keys")[0].alias("b")).agg(F.sum("n").alias("n"))
    beside = pairs.select(F.explode(F.array(F.struct(F.col("b").alias("form"), F.concat(F.lit("<"), "a").alias("key")), F.struct(F.col("a").alias("form"), F.concat(F.lit(">"), "b").alias("key")))).alias("x"), "n").select("x.*", "n")
    about = ev.where("kind in ('word', 'name')").select("kind", "lang", "a", F.explode("keys").alias("key")).groupBy("kind", "lang", "a", "key").agg(F.count("*").alias("times"))
    support = rare.join(about, ["kind", "lang", "a"]).join(beside, ["form", "key"]).groupBy("kind", "lang", "a", "form").agg(F.sum("times").alias("support"))
    best = rare.join(support, ["kind", "lang", "a", "form"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    return best.where("kind = 'word' or support >= n").groupBy("kind", "lang", "a").agg(F.max_by("form", F.struct("support", "form_n", "form")).alias("form"))


def with_forms(ev: DataFrame, miss: DataFrame) -> DataFrame:
    """Events of misread words with the form meant. The misread words are counted before they are broadcast."""
    few = miss.count() <= BROADCAST_WORDS
    return ev.where("kind in ('word', 'name')").join(F.broadcast(miss) if few else miss, ["kind", "lang", "a"])


def header_lines(ev: DataFrame, files: DataFrame) -> DataFrame:
    """tbl, row_uid, line of running headers. Lines meet titles on file and key; those of a file with many are split."""
    titles = files.where("title is not null").select("doc_id", "title").distinct().select("doc_id", F.explode(_keys_of("title")).alias("key")).where("length(key) > 3").distinct()
    lines = ev.where("kind = 'line'").select("tbl", "row_uid", "doc_id", "line", F.explode("keys").alias("key"))
    return split_join(lines, titles, ["doc_id", "key"], ["tbl", "row_uid", "line"]).select("tbl", "row_uid", "line").distinct()


def page_lines(ev: DataFrame) -> DataFrame:
    """tbl, row_uid, line of page numbers: those that differ from the page's place by what is usual in the file, or by
    one, and Roman numerals of front matter. Only files whose usual difference isn't one are looked up; their lines are split."""
    got = ev.where("kind = 'page'").select("tbl", "row_uid", "doc_id", "line", "n", "a")
    per = got.where("a is null").groupBy("doc_id", "n").agg(F.countDistinct("row_uid", "tbl").alias("times"))
    usual = per.groupBy("doc_id").agg(F.max_by("n", F.struct("times", -F.abs(F.col("n") - 1))).alias("n")).where("n != 1")
    plain = got.where("n = 1 or a is not null").select("tbl", "row_uid", "line")
    other = split_join(got.where("n != 1 and a is null"), usual, ["doc_id", "n"], ["tbl", "row_uid", "line"]).select("tbl", "row_uid", "line")
    return plain.unionByName(other).distinct()


def cuts(ev: DataFrame) -> DataFrame:
    """tbl, row_uid, line, keep: cuts at line ends; keep where the parts are a compound with a hyphen."""
    got = ev.where("kind = 'cut'").select("tbl", "row_uid", "line", F.posexplode("keys").alias("nth", "key"))
    compounds = ev.where("kind = 'compound'").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n")).where(F.col("n") >= COMPOUND)
    marked = got.join(compounds, "key", "left")
    return marked.groupBy("tbl", "row_uid", "line").agg(F.max(F.col("n").isNotNull()).alias("keep"))


def found(texts: DataFrame, files: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tbl, row_uid, noise: a row for each text and kind of noise in it.

    Null and empty texts have none; a text delivered twice counts once; texts without page_index are taken to be on
    the first page; files without title have no header; further columns are ignored."""
    ev = written(events(texts, lexicon, files), "events")
    miss = written(misreadings(ev, lexicon), "misread")
    row = lambda df, noise: df.select("tbl", "row_uid", F.lit(noise).alias("noise"))
    parts = [
        row(with_forms(ev, miss), "misread"),
        row(header_lines(ev, files), "header"),
        row(page_lines(ev), "page_no"),
        row(cuts(ev).where("not keep"), "hyphen"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


@F.pandas_udf(T.StringType())
def _with_forms(text: pd.Series, forms: pd.Series) -> pd.Series:
    """The text with misread words replaced, a first capital kept."""

    def one(t: str, pairs) -> str:
        if t is None or pairs is None or not len(pairs):
            return t
        d = {p["a"]: p["form"] for p in pairs}

        def put(m: re.Match) -> str:
            f = d.get(m[0].lower())
            return m[0] if f is None else f.capitalize() if m[0][0].isupper() else f

        return _TOKEN.sub(put, t)

    return pd.Series([one(t, p) for t, p in zip(text, forms, strict=True)], index=text.index)


def _tabular(line: Column) -> Column:
    """Lines that stay lines: figures, or fields set apart by tabs."""
    return line.contains("\t") | line.rlike(r"^\s*[-+]?[\d.,]+(\s*\p{L}{1,3})?\s*$")


def repaired(texts: DataFrame, files: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tbl, row_uid, repaired: every non-null text as continuous paragraphs.

    Paragraphs are kept apart by a line break; lines of figures stay lines. Texts without noise and with
    one line come out as they are. Null texts come out null; a text delivered twice comes out once."""
    one = once(texts.select("tbl", "row_uid", "doc_id", "page_index", "text"), "tbl", "row_uid")
    ev = written(events(one, lexicon, files), "events")
    miss = written(misreadings(ev, lexicon), "misread")
    is_multi = F.coalesce(F.col("text").rlike(LINE_BREAK), F.lit(False))
    # a line's mark (left out, or cut and whether its hyphen is kept) goes before it in one sorted sequence of the text, so that lines are shuffled once
    lines = one.where(is_multi).select("tbl", "row_uid", F.posexplode(F.split("text", LINE_BREAK, -1)).alias("line", "s"), F.lit(1).alias("after"))
    off = header_lines(ev, files).unionByName(page_lines(ev)).distinct().select("tbl", "row_uid", "line", F.lit(True).alias("off"), F.lit(None).cast("boolean").alias("keep"))
    cut = cuts(ev).select("tbl", "row_uid", "line", F.lit(None).cast("boolean").alias("off"), "keep")
    marks = off.unionByName(cut).groupBy("tbl", "row_uid", "line").agg(F.max("off").alias("off"), F.max("keep").alias("keep")).withColumn("after", F.lit(0))
    both = lines.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("tbl", "row_uid").orderBy("line", "after")
    mine = F.lag("line").over(w) == F.col("line")
    both = both.withColumn("off", F.when(mine, F.lag("off").over(w))).withColumn("keep", F.when(mine, F.lag("keep").over(w)))
    s = strip(F.col("s"))
    bare = F.when(F.col("keep").isNotNull(), F.when(F.col("keep"), F.regexp_replace(s, f"[{MARKS}]$", "-")).otherwise(F.regexp_replace(s, f"[{MARKS}]$", ""))).otherwise(s)
    both = both.withColumn("out", F.when((F.col("after") == 1) & F.col("off").isNull(), bare)).withColumn("there", F.coalesce(F.col("out") != "", F.lit(False)))
    this = F.struct("keep", _tabular(F.col("s")).alias("alone"))
    both = both.withColumn("this", F.when(F.col("there"), this)).withColumn("last", F.last("this", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    gap = F.when(F.col("last").isNull(), "").when(F.col("last.keep").isNotNull(), "").when(F.col("this.alone") | F.col("last.alone"), "\n").otherwise(" ")
    pieces = F.collect_list(F.when(F.col("there"), F.struct("line", F.concat(gap, "out").alias("out"))))
    joined = both.groupBy("tbl", "row_uid").agg(F.array_join(F.transform(F.array_sort(pieces), lambda x: x["out"]), "").alias("text"))
    texts_ = joined.unionByName(one.where(~is_multi).select("tbl", "row_uid", "text"))
    forms = with_forms(ev, miss).groupBy("tbl", "row_uid").agg(F.collect_set(F.struct("a", "form")).alias("forms"))
    base = texts_.join(forms, ["tbl", "row_uid"], "left")
    return base.select("tbl", "row_uid", F.when(F.col("forms").isNull(), F.col("text")).otherwise(_with_forms(F.when(F.col("forms").isNotNull(), F.col("text")), "forms")).alias("repaired"))  # other texts stay in the JVM

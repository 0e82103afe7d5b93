"""Near-duplicate texts: a chosen-path similarity join over word shingles.

Every distinct text (by its sequence of words) gets T minwise tokens of its
shingle set and a 192-bit sketch of one-bit minwise hashes. R independent
trees begin at a root that holds all texts; a node branches its texts by
selected minwise tokens, a small node compares all its texts by their sketches.
A pair above the threshold stays together in a branch with a probability of
its similarity, so that R trees with about 1/threshold branches a node reach
the target recall. Pairs that pass the sketches are checked on their exact
shingle sets.

How it runs: texts are read once; one table of signatures is written. Nodes
that a bounded sample (`sample_rows`, for planning only) shows to be large are
branched at once, where rows are made, so no hot node is ever shuffled whole.
Rows are shuffled by node and compared in a stream over the sorted rows; a node
that still exceeds `node_limit` passes through it into the next round and is
branched further there. When a path has used `max_depth` tokens, its texts are
compared in blocks, so nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.scratch import written
from pagewright.llm.shingles import mix, shingle_hashes, word_hashes

SIG = "tbl string, row_uid long, c1 long, c2 long, s1 long, s2 long, s3 long, mh array<int>"
SKETCH = ["s1", "s2", "s3"]
BITS = 64 * len(SKETCH)
ROWS = "node long, path array<int>, tbl string, id long, s1 long, s2 long, s3 long"


@dataclass(frozen=True)
class Params:
    """threshold: least Jaccard similarity; shingle: words in a shingle; min_words: shorter texts
    are left out; tokens: T; trees: R; branches: of a large node; node_limit: size from which a node
    that the sample shows is branched (one that comes out up to twice as large is still compared
    exhaustively); sample_rows: texts looked at for hot nodes."""

    threshold: float = 0.8
    shingle: int = 5
    min_words: int = 5
    tokens: int = 24
    trees: int = 9
    branches: int = 3
    node_limit: int = 250
    max_depth: int = 6
    sample_rows: int = 40_000
    seed: int = 11

    @property
    def sketch_bits(self) -> int:
        """Bits that must agree: at the threshold, fewer agree once in about 400 pairs."""
        p = (1 + self.threshold) / 2
        return int(BITS * p - 2.8 * np.sqrt(BITS * p * (1 - p)))

    def children(self, path: tuple[int, ...]) -> list[int]:
        """The tokens by which a node with this path branches."""
        rest = [i for i in range(self.tokens) if i not in path]
        rng = np.random.default_rng([self.seed, len(path), *path])
        return [int(i) for i in rng.permutation(rest)[: self.branches]]


def _minima(h: np.ndarray, first: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least value of each text's shingles under each seeded hash, as 32 bits; two hashes of one product."""
    out = np.empty((len(first), 2 * len(seeds)), np.uint32)
    with np.errstate(over="ignore"):
        for j, s in enumerate(seeds):
            x = (h ^ s) * (s | np.uint64(1))
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, 2 * j] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), first)
            x ^= x >> np.uint64(32)
            out[:, 2 * j + 1] = np.minimum.reduceat(x.astype(np.uint32), first)
    return out


def signatures(texts: DataFrame, p: Params) -> DataFrame:
    """tbl, row_uid, text -> a row for each text of at least min_words words: two halves of a hash of
    its words (c1, c2), its sketch (s1, s2, s3) and its minwise tokens."""
    seeds = np.random.default_rng(p.seed).integers(1, 1 << 63, BITS // 2 + (p.tokens + 1) // 2, dtype=np.uint64)
    least = max(p.min_words, p.shingle)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                pdf = whole.iloc[at : at + 1000]
                words, counts = word_hashes(list(pdf.text))
                keep = counts >= least
                if not keep.any():
                    continue
                words, counts, pdf = words[np.repeat(keep, counts)], counts[keep], pdf[keep]
                start = np.cumsum(counts) - counts
                with np.errstate(over="ignore"):
                    place = mix((np.arange(len(words)) - np.repeat(start, counts)).astype(np.uint64) + np.uint64(p.seed))
                    c1 = np.add.reduceat(mix(words ^ place), start)
                    c2 = np.add.reduceat(mix(words + place), start)
                h, m = shingle_hashes(words, counts, p.shingle)
                low = _minima(h, np.cumsum(m) - m, seeds)
                bits = (low[:, p.tokens : p.tokens + BITS] & 1).astype(np.uint8)
                sketch = np.packbits(bits, axis=1).view(np.int64)
                yield pd.DataFrame({"tbl": pdf.tbl.values, "row_uid": pdf.row_uid.values, "c1": c1.view(np.int64), "c2": c2.view(np.int64), **{s: sketch[:, i] for i, s in enumerate(SKETCH)}, "mh": list(low[:, : p.tokens].view(np.int32))})

    least_chars = 2 * least - 1
    return texts.where(F.length("text") >= least_chars).select("tbl", "row_uid", "text").mapInPandas(run, SIG)


def _key(salt: np.ndarray | int, path: tuple[int, ...], mh: np.ndarray) -> np.ndarray:
    """A node: its table, the tokens of its path and their values in the texts."""
    with np.errstate(over="ignore"):
        k = np.full(len(mh), 0, np.uint64) + np.uint64(salt)
        for i in path:
            k = mix(k * np.uint64(31) + np.uint64(i + 1) + (mh[:, i].astype(np.uint64) << np.uint64(20)))
    return k


def _salt(tbl: str) -> int:
    return int.from_bytes(tbl.encode()[:7].ljust(7, b"\0"), "little")


def _walk(p: Params, mh: np.ndarray, salt: int, hot: np.ndarray, starts: list[tuple[int, ...]]):
    """Branches texts as long as their nodes are hot; yields (path, node keys, positions of the texts)."""
    todo = [(s, np.arange(len(mh))) for s in starts]
    while todo:
        path, at = todo.pop()
        key = _key(salt, path, mh[at])
        is_hot = np.isin(key, hot) if len(path) < p.max_depth else np.zeros(len(key), bool)
        if (~is_hot).any():
            yield path, key[~is_hot], at[~is_hot]
        if is_hot.any():
            todo += [((*path, c), at[is_hot]) for c in p.children(path)]


def _hot_nodes(reps: DataFrame, p: Params, n: int) -> np.ndarray:
    """Keys of nodes that the sample shows to exceed the limit; at most sample_rows texts are seen,
    so there are fewer than sample_rows * trees * branches / least of them, whatever the input."""
    share = min(1.0, p.sample_rows / max(1, n))
    pdf = reps.select("tbl", "mh").sample(fraction=share, seed=p.seed).limit(2 * p.sample_rows).toPandas()
    least = max(8, int(p.node_limit * share))
    hot: set[int] = set()
    for tbl, g in pdf.groupby("tbl"):
        mh, todo = np.array(list(g.mh), np.int64).astype(np.uint32), [((i,), np.arange(len(g))) for i in range(p.trees)]
        while todo:
            path, at = todo.pop()
            key = _key(_salt(str(tbl)), path, mh[at])
            values, counts = np.unique(key, return_counts=True)
            big = values[counts >= least]
            if len(big) and len(path) < p.max_depth:
                hot.update(int(x) for x in big)
                inside = at[np.isin(key, big)]
                todo += [((*path, c), inside) for c in p.children(path)]
    return np.array(sorted(hot), np.uint64)


def _node_rows(reps: DataFrame, p: Params, hot: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tbl, g in pdf.groupby("tbl"):
                mh = np.array(list(g.mh), np.int64).astype(np.uint32)
                for path, key, at in _walk(p, mh, _salt(str(tbl)), hot, [(i,) for i in range(p.trees)]):
                    yield pd.DataFrame({"node": key.view(np.int64), "path": [np.array(path, np.int32)] * len(key), "tbl": tbl, "id": g.row_uid.values[at], **{s: g[s].values[at] for s in SKETCH}})

    return reps.select("tbl", "row_uid", *SKETCH, "mh").mapInPandas(run, ROWS)


def _next_rows(big: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """Children of the nodes that were too large."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.uint64)
        for pdf in batches:
            for (tbl, path), g in pdf.assign(path=pdf.path.map(tuple)).groupby(["tbl", "path"]):
                mh = np.array(list(g.mh), np.int64).astype(np.uint32)
                starts = [(*path, c) for c in p.children(path)]
                for to, key, at in _walk(p, mh, _salt(str(tbl)), none, starts):
                    yield pd.DataFrame({"node": key.view(np.int64), "path": [np.array(to, np.int32)] * len(key), "tbl": tbl, "id": g.id.values[at], **{s: g[s].values[at] for s in SKETCH}})

    both = big.join(reps.select(F.col("tbl"), F.col("row_uid").alias("id"), "mh"), ["tbl", "id"])
    return both.select("tbl", "path", "id", *SKETCH, "mh").mapInPandas(run, ROWS)


def _pairs_within(node: np.ndarray, sketch: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of one node whose sketches agree; rows are sorted by node."""
    left, right = [], []
    n, d = len(node), 1
    at = np.arange(n - 1) if n > 1 else np.zeros(0, int)
    while len(at):  # those that have a row of their node at distance d
        at = at[at + d < n]
        at = at[node[at] == node[at + d]]
        agree = BITS - sum(np.bitwise_count(s[at] ^ s[at + d]).astype(np.int16) for s in sketch)
        ok = at[agree >= least]
        left.append(ok)
        right.append(ok + d)
        d += 1
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(left), np.concatenate(right)


def _compare(rows: DataFrame, p: Params, last: bool) -> DataFrame:
    """Rows shuffled and sorted by node -> pairs (path null), and the rows of nodes beyond the limit as they are
    (b null). On the last round nothing is beyond it."""
    least, limit = p.sketch_bits, 2 * p.node_limit
    cols = ["node", "path", "tbl", "id", *SKETCH]

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = _pairs_within(pdf.node.values, [pdf[s].values.view(np.uint64) for s in SKETCH], least)
        ids = pdf.id.values  # those of a text delivered twice are equal
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        out = pd.DataFrame({"tbl": pdf.tbl.values[i], "a": a, "b": b})
        return out[a != b].drop_duplicates().assign(node=0, path=None, **dict.fromkeys(SKETCH, 0))

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.rename(columns={"id": "a"}).assign(b=pd.array([None] * len(pdf), "Int64"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, passing = None, None  # rows of the node that the batch before ended in; the node that passes through
        for pdf in batches:
            if passing is not None:
                more = pdf.node.values == passing
                if more.any():
                    yield through(pdf[more])
                    pdf = pdf[~more]
                if not len(pdf):
                    continue
                passing = None
            if kept is not None:
                pdf = pd.concat([kept, pdf], ignore_index=True)
            node = pdf.node.values
            sizes = np.diff(np.flatnonzero(np.r_[True, node[1:] != node[:-1], True]))
            if not last and (sizes > limit).any():
                big = np.repeat(sizes > limit, sizes)
                yield through(pdf[big])
                if big[-1]:
                    passing = node[-1]
                pdf, node = pdf[~big], node[~big]
                if not len(pdf):
                    kept = None
                    continue
            if passing is None:
                end = node != node[-1]
                kept, pdf = pdf[~end], pdf[end]
            else:
                kept = None
            if len(pdf):
                yield found(pdf)
        if kept is not None and len(kept):
            yield found(kept)

    out = "node long, path array<int>, tbl string, a long, b long, s1 long, s2 long, s3 long"
    order = ["node", "path", "tbl", "a", "b", *SKETCH]
    return rows.select(*cols).repartition("node").sortWithinPartitions("node").mapInPandas(lambda it: (x[order] for x in run(it)), out)


def _compare_blocks(rows: DataFrame, p: Params, block: int = 4096) -> DataFrame:
    """Nodes whose texts agree in max_depth tokens: block against block, so no task holds a whole node."""
    count = rows.groupBy("node").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    rows = rows.join(count, "node").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    cell = rows.withColumn("node", F.xxhash64("node", "lo", "hi"))
    return _compare(cell, p, last=True)


def candidate_pairs(reps: DataFrame, p: Params) -> DataFrame:
    """tbl, a, b (a < b) of representatives whose sketches agree in some small node."""
    n = reps.count()
    rows = _node_rows(reps, p, _hot_nodes(reps, p, n))
    parts = []
    for depth in range(p.max_depth):
        got = written(_compare(rows, p, last=False), "nodes")
        parts.append(got.where("b is not null"))
        big = got.where("b is null")
        if not big.take(1):
            break
        big = big.withColumnRenamed("a", "id")
        if depth == p.max_depth - 1:
            parts.append(_compare_blocks(big, p))
            break
        deep = big.where(F.size("path") >= p.max_depth)
        if deep.take(1):
            parts.append(_compare_blocks(deep, p))
        rows = _next_rows(big.where(F.size("path") < p.max_depth), reps, p)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("tbl", "a", "b").distinct()


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """tbl, row_uid -> its set of shingles as 64-bit hashes, sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, counts = word_hashes(list(pdf.text))
            h, m = shingle_hashes(words, counts, k)
            ends = np.cumsum(m)
            yield pd.DataFrame({"tbl": pdf.tbl.values, "row_uid": pdf.row_uid.values, "shingles": [np.unique(x).view(np.int64) for x in np.split(h, ends[:-1])] if len(ends) else []})

    return texts.select("tbl", "row_uid", "text").mapInPandas(run, "tbl string, row_uid long, shingles array<long>")


#: Ids that are broadcast at most (16 bytes each); beyond it their join is shuffled.
BROADCAST_IDS = 500_000


def similar_pairs(texts: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, copies, compared) of tbl, row_uid, text. Pairs: tbl, a, b, similarity between representatives,
    one for each sequence of words; copies: tbl, row_uid, rep where several rows have one representative;
    compared: tbl, row_uid of every text with enough words (twice, if it was delivered twice).

    Null and empty texts have no words and never appear; a row_uid that is repeated counts once;
    further columns are ignored; empty input gives empty tables."""
    sig = written(signatures(texts, p), "signatures")
    firsts = sig.groupBy("tbl", "c1", "c2").agg(F.min("row_uid").alias("rep"), F.max("row_uid").alias("hi")).where("rep != hi").drop("hi")
    copies = written(sig.select("tbl", "c1", "c2", "row_uid").join(firsts, ["tbl", "c1", "c2"]).select("tbl", "row_uid", "rep").distinct(), "copies")
    later = copies.where("row_uid != rep").select("tbl", "row_uid")
    reps = sig.join(F.broadcast(later) if later.count() <= BROADCAST_IDS else later, ["tbl", "row_uid"], "left_anti")
    found = written(candidate_pairs(reps, p), "candidates")
    ids = found.select("tbl", F.explode(F.array("a", "b")).alias("row_uid")).distinct()
    few = ids.count() <= BROADCAST_IDS
    used = texts.where(F.col("text").isNotNull()).select("tbl", "row_uid", "text").join(F.broadcast(ids) if few else ids, ["tbl", "row_uid"])
    sets = written(shingle_sets(used, p.shingle), "sets")
    a = sets.select("tbl", F.col("row_uid").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select("tbl", F.col("row_uid").alias("b"), F.col("shingles").alias("sb"))
    both = found.join(a, ["tbl", "a"]).join(b, ["tbl", "b"])
    shared = F.size(F.array_intersect("sa", "sb"))
    pairs = both.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("sa") + F.size("sb") - F.col("shared")))
    pairs = pairs.where(F.col("similarity") >= p.threshold).select("tbl", "a", "b", "similarity").distinct()
    return pairs, copies, sig.select("tbl", "row_uid")


def expanded(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """Pairs of rows: those of linked representatives, and those of one representative."""
    own = copies.where("row_uid = rep").select("tbl", F.col("rep").alias("a"), F.col("rep").alias("b"))
    links = pairs.select("tbl", "a", "b").unionByName(own)
    left = copies.select("tbl", F.col("rep").alias("a"), F.col("row_uid").alias("x"))
    right = copies.select("tbl", F.col("rep").alias("b"), F.col("row_uid").alias("y"))
    rows = links.join(left, ["tbl", "a"], "left").join(right, ["tbl", "b"], "left").withColumn("x", F.coalesce("x", "a")).withColumn("y", F.coalesce("y", "b"))
    return rows.where("a != b or x < y").select("tbl", F.least("x", "y").alias("uid_a"), F.greatest("x", "y").alias("uid_b"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of tbl, a, b: tbl, node, root (the least id), by alternating large-star and
    small-star steps until nothing changes; each step is written, and hubs only ever send their least neighbour."""
    e = written(edges.select("tbl", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select("tbl", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("tbl", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, ["tbl", "u"]).where("v > u").select("tbl", F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("tbl", "u").agg(F.min("v").alias("m"))
        small = large.join(down, ["tbl", "u"]).where("v != m").select("tbl", F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(down.select("tbl", "u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        if not new.exceptAll(e).take(1) and not e.exceptAll(new).take(1):
            break
        e = new
    return e.groupBy("tbl", F.col("u").alias("node")).agg(F.min("v").alias("root"))


def groups(texts: DataFrame, p: Params) -> DataFrame:
    """A row for each text with enough words: tbl, row_uid, group_uid (least id of its group), links (number of
    different texts it is similar to)."""
    pairs, copies, compared = similar_pairs(texts, p)
    pairs = written(pairs, "pairs")
    ends = pairs.select("tbl", F.explode(F.array("a", "b")).alias("rep")).groupBy("tbl", "rep").agg(F.count("*").alias("links"))
    roots = components(pairs).select("tbl", F.col("node").alias("rep"), "root")
    out = compared.distinct().join(copies, ["tbl", "row_uid"], "left").withColumn("rep", F.coalesce("rep", "row_uid"))
    out = out.join(ends, ["tbl", "rep"], "left").join(roots, ["tbl", "rep"], "left")
    return out.select("tbl", "row_uid", F.coalesce("root", "rep").alias("group_uid"), F.coalesce("links", F.lit(0)).alias("links"))

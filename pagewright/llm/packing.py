"""Documents assigned to containers of a fixed number of tokens.

Best-two-fit: a container begins with the largest document left and is filled with the
largest that fit; then its smallest document is exchanged for the two unpacked ones that
together fill the room so gained best. Only documents above the capacity are split, into
full containers and a rest that is packed like a document.

Containers don't care which documents meet in them, so documents are dealt by a hash into
shards of a bounded number, each packed on its own: no task holds more than a shard, and
each shard leaves at most a few containers that aren't full.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.scratch import written

#: Documents in a shard, about.
SHARD_ROWS = 20_000
PACKED = "container_id string, doc_id long, piece int, token_start long, token_end long, n_tokens int"


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in `sizes`; every size is within the capacity. Ties go to the earlier position."""
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(sizes) - 1, -1, -1):
        by_size[sizes[i]].append(i)
    left = np.array([len(x) for x in by_size])
    mask = sum(1 << s for s in range(1, capacity + 1) if left[s])
    out: list[list[int]] = []

    def take(s: int) -> int:
        nonlocal mask
        left[s] -= 1
        if not left[s]:
            mask &= ~(1 << s)
        return by_size[s].pop()

    def back(s: int, i: int) -> None:
        nonlocal mask
        by_size[s].append(i)
        left[s] += 1
        mask |= 1 << s

    def largest(room: int) -> int:
        return (mask & ((1 << (room + 1)) - 1)).bit_length() - 1

    while mask:
        room, bin_ = capacity, []
        while room > 0 and (s := largest(room)) > 0:
            bin_.append((s, take(s)))
            room -= s
        if room > 0 and mask and len(bin_) > 1:
            small = bin_[-1][0]
            grown = room + small
            have = np.flatnonzero(left[: grown + 1])
            have = have[have > 0]
            if len(have):
                below = np.zeros(grown + 1, np.int64)  # the largest size at hand up to each room
                below[have] = have
                below = np.maximum.accumulate(below)
                other = below[grown - have]
                alone = (other == have) & (left[have] < 2)
                other[alone] = below[np.maximum(other[alone] - 1, 0)]
                both = np.where(other > 0, have + other, 0)
                k = int(both.argmax())
                if both[k] > small:
                    s, i = bin_.pop()
                    a, b = int(have[k]), int(other[k])
                    bin_ += [(a, take(a)), (b, take(b))]
                    back(s, i)
        out.append([i for _, i in bin_])
    empty = by_size[0][::-1]
    if empty:
        out = out or [[]]
        out[-1] += empty
    return out


def pack(sized: DataFrame, capacity: int, name: str = "c", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, n_tokens -> container_id, doc_id, piece, token_start, token_end, n_tokens.

    Every document comes out whole in one container, or in pieces if it exceeds the capacity. Documents
    without tokens join the last container of their shard; a doc_id that is repeated comes out once; a null one is
    an id like any other; an empty table gives an empty table."""
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    one = sized.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    shards = max(1, round(one.count() / shard_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        shard = int(pdf.shard.iloc[0])
        rows, rest = [], []
        full = 0
        for doc, n in zip(pdf.doc_id.astype("Int64"), pdf.n_tokens, strict=True):
            doc = None if pd.isna(doc) else int(doc)
            whole, over = divmod(int(n), capacity) if n > capacity else (0, int(n))
            for i in range(whole):
                rows.append((f"{name}-{shard}-f{full}", doc, i, i * capacity, (i + 1) * capacity, capacity))
                full += 1
            if over or not whole:
                rest.append((doc, whole, whole * capacity, over))
        for k, bin_ in enumerate(best_two_fit([r[3] for r in rest], capacity)):
            rows += [(f"{name}-{shard}-{k}", rest[i][0], rest[i][1], rest[i][2], rest[i][2] + rest[i][3], rest[i][3]) for i in bin_]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])
        out["doc_id"] = out.doc_id.astype("Int64")
        return out

    return one.withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(shards))).groupBy("shard").applyInPandas(run, PACKED)


def packed(docs: DataFrame, capacities: dict[str, int], lengths) -> DataFrame:
    """limit_name and the columns of pack() for each capacity; tokens are counted once."""
    sized = written(lengths(docs.select("doc_id", "text")), "lengths")
    parts = [pack(sized, size, name).select(F.lit(name).alias("limit_name"), "*") for name, size in capacities.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill(packed_rows: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """limit_name, containers, documents, tokens, filled: the share of the room that is used."""
    size = F.create_map(*[x for k, v in capacities.items() for x in (F.lit(k), F.lit(v))])
    g = packed_rows.groupBy("limit_name").agg(F.countDistinct("container_id").alias("containers"), F.countDistinct("doc_id").alias("documents"), F.sum("n_tokens").alias("tokens"))
    return g.withColumn("filled", F.col("tokens") / (F.col("containers") * size[F.col("limit_name")]))

"""Filling fixed-capacity containers: conflict-constrained best fit.

Items are spread over blocks by the hash of their key; each block is packed on its own, so a block leaves a
handful of half-full containers and no more. In a block, items come by falling size. Open containers are
ordered by what room is left in them; the search starts at the tightest one that could take the item and goes
on to the successors until one is compatible. A container carries two bitmaps: the duplicate clusters in it,
which must not meet again, and the sources in it, which decide between containers of equal room.

Only an item larger than the capacity is split: into full containers and a rest that is packed like any item.
An item of size 0 (null and empty texts) takes no room and has no container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import bpe
from vitrine.session import cut

CAPACITY = 2048
#: Items wanted in a block.
BLOCK_ITEMS = 40_000
#: Containers of equal room looked at for one without the item's source.
_EQUAL_ROOM = 8


def best_fit(sizes: np.ndarray, clusters: np.ndarray, sources: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (sizes 1..capacity, in the order given). clusters: -1 for no duplicate.

    Copies that follow one another share one search: a container that took one of them, or was found to hold their
    cluster, stands aside until the last of them is placed. So no container is looked at twice for a run of copies.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: some container has room r
    dup_of: list[int] = []
    src_of: list[int] = []
    aside: list[tuple[int, int]] = []
    run = (-1, -1)
    out = np.empty(len(sizes), np.int64)
    for k in range(len(sizes)):
        size, cluster, source = int(sizes[k]), int(clusters[k]), 1 << int(sources[k])
        mark = 1 << cluster if cluster >= 0 else 0
        if (cluster, size) != run or not mark:
            for c, r in aside:
                by_room[r].append(c)
                filled |= 1 << r
            aside, run = [], (cluster, size)
        rest, base, chosen = filled >> size, size, -1
        while rest:
            room = base + (rest & -rest).bit_length() - 1
            shelf = by_room[room]
            while mark and shelf and dup_of[shelf[-1]] & mark:
                aside.append((shelf.pop(), room))
            at = len(shelf) - 1
            i = at - 1
            # of equal rooms the first without the item's source is preferred
            while at >= 0 and src_of[shelf[at]] & source and i >= max(0, len(shelf) - _EQUAL_ROOM):
                if not src_of[shelf[i]] & source and not (mark and dup_of[shelf[i]] & mark):
                    at = i
                i -= 1
            if at >= 0:
                chosen = shelf[at]
                shelf[at] = shelf[-1]
                shelf.pop()
            if not shelf:
                filled &= ~(1 << room)
            if chosen >= 0:
                break
            base = room + 1
            rest = filled >> base
        if chosen < 0:
            chosen, room = len(dup_of), capacity
            dup_of.append(0)
            src_of.append(0)
        dup_of[chosen] |= mark
        src_of[chosen] |= source
        room -= size
        if room and mark:
            aside.append((chosen, room))
        elif room:
            by_room[room].append(chosen)
            filled |= 1 << room
        out[k] = chosen
    return out


def _pack_block(t: pd.DataFrame, capacity: int) -> pd.DataFrame:
    t = t.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable", na_position="last").reset_index(drop=True)
    block = int(t["block"].iloc[0])
    n = t["n_tokens"].to_numpy(np.int64)
    pieces = np.maximum(1, -(-n // capacity))
    row = np.repeat(np.arange(len(t)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(capacity, n[row] - piece * capacity)
    seen = t["cluster"].value_counts()
    shared = {c: i for i, c in enumerate(sorted(seen.index[seen > 1]))}
    clusters = t["cluster"].map(shared).fillna(-1).to_numpy(np.int64)[row]
    clusters[(pieces > 1)[row] & (piece < pieces[row] - 1)] = -1  # a full piece meets nothing
    order = np.lexsort((clusters, -size))  # copies follow one another
    live = order[size[order] > 0]
    sources = pd.factorize(t["source"], use_na_sentinel=False)[0][row]
    where = np.full(len(row), -1, np.int64)
    where[live] = best_fit(size[live], clusters[live], sources[live], capacity)
    container = pd.array((np.int64(block) << 32) | where, dtype="Int64")
    container[where < 0] = pd.NA
    return pd.DataFrame({"container_id": container, "doc_id": t["doc_id"].to_numpy()[row], "piece": piece.astype(np.int32), "start_token": (piece * capacity).astype(np.int32), "n_tokens": size.astype(np.int32)})


def pack(items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(container_id, doc_id, piece, start_token, n_tokens) for items (doc_id, source, cluster, n_tokens).

    Rows are kept as they are: a doc_id given twice is two items. Each item is packed once; containers never
    hold more than ``capacity``.
    """
    blocks = max(1, -(-items.count() // block_items))
    placed = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(blocks)).cast("int"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        return _pack_block(t, capacity)

    return placed.groupBy("block").applyInPandas(run, "container_id bigint, doc_id bigint, piece int, start_token int, n_tokens int")


def document_items(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Items of documents: sizes in tokens, and the hash of the text without case and blanks as duplicate cluster."""
    sized = documents.select("doc_id", "source", F.xxhash64(F.lower(F.regexp_replace("text", r"\s+", ""))).alias("cluster"), "text")
    return bpe.encode(sized, path=path, sizes_only=True, keep=("source", "cluster"))


def p9_containers(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every document in its containers. The items are sized once, then kept in the shared folder for both passes."""
    return pack(cut(document_items(documents)), capacity)


def p9_fill(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, the tokens in them, the share of their room that is filled, and the fewest containers possible."""
    packed = p9_containers(documents, capacity).filter("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    total, room = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)) * capacity
    return packed.agg(F.count(F.lit(1)).alias("containers"), total.alias("tokens"), F.round(total / F.nullif(room, F.lit(0)), 5).alias("filled"), F.ceil(total / capacity).alias("fewest"))

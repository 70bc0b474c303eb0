"""Trigram similarity as Column expressions, and a batch join through inverted trigram indexes."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vitrine.session import cut

#: Texts of one side that one task holds at most, about; and the common trigrams that must meet early.
SHARE, MEET = 100_000, 3


def _padded(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def ordered_trigrams(c: Column) -> Column:
    """Trigrams of every word in order: two blanks before a word, one after it."""
    each = F.transform(_padded(c), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.flatten(each)


def trigrams(c: Column) -> Column:
    """Distinct trigrams; empty for a text without letters or digits."""
    return F.array_distinct(ordered_trigrams(c))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram sets; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


_WORDS = re.compile(r"[^\W_]+")


def _listed(text: str) -> list[str]:
    out = []
    for w in _WORDS.findall(text.lower()):
        w = f"  {w} "
        out += [w[i : i + 3] for i in range(len(w) - 2)]
    return out


def both_similarities(query: str, text: Column) -> Column:
    """struct<sim, part> of a fixed query and a text column: ``similarity`` and ``word_similarity``, in Arrow batches.

    The stretches of long names are quadratic in the trigrams they share with the query; here a name that shares none
    costs a set intersection.
    """
    q = frozenset(_listed(query))

    @pandas_udf("struct<sim double, part double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        sims, parts = [], []
        for t in texts:
            listed = _listed(t) if t else []
            shared = q.intersection(listed)
            sims.append(len(shared) / len(q.union(listed)) if shared else 0.0)
            best = 0.0
            if shared:
                at = [i for i, g in enumerate(listed) if g in q]
                for n, i in enumerate(at):
                    seen: set[str] = set()
                    hit, done = 0, i
                    for j in at[n:]:
                        for g in listed[done : j + 1]:
                            if g not in seen:
                                seen.add(g)
                                hit += g in q
                        done = j + 1
                        best = max(best, hit / (len(q) + len(seen) - hit))
            parts.append(best)
        return pd.DataFrame({"sim": sims, "part": parts})

    return run(text)


def word_similarity(q: Column, t: Column) -> Column:
    """Greatest similarity of the trigram set ``q`` with a stretch of the ordered trigrams ``t``.

    Only stretches that begin and end with a trigram of ``q`` can be greatest.
    """
    at = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: F.array_contains(q, F.element_at(t, i)))
    each = F.flatten(
        F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j >= i), lambda j: similarity(q, F.array_distinct(F.slice(t, i, j - i + 1)))))
    )
    return F.when((F.size(t) > 0) & (F.size(q) > 0), F.coalesce(F.array_max(each), F.lit(0.0))).otherwise(0.0)


def _close_sets(at: np.ndarray, an: np.ndarray, bt: np.ndarray, bn: np.ndarray, threshold: float, best: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, sim) of sets of ``threshold`` or more; ``at``, ``bt``: their elements, end to end; ``an``, ``bn``: their sizes.

    All sets are ordered alike, rarest element first. Two sets whose sizes ask for n common elements have the first
    three of these (or n) no later than n - 3 elements before the end of either. So where fewer meet that early, the
    sets aren't compared.
    """
    _, ids = np.unique(np.concatenate([at, bt]), return_inverse=True)
    df = np.bincount(ids[len(at) :], minlength=ids.max() + 1)
    many, each = len(df), MEET - 1
    rank = np.empty(many, np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(many)

    def ordered(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        start = np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        return np.sort(row * many + rank[ids]) % many, row, np.arange(len(ids)) - np.repeat(start, n), start

    share = threshold / (1 + threshold)
    ta, ra, pa_, _ = ordered(ids[: len(at)], an)
    tb, rb, pb, start_b = ordered(ids[len(at) :], bn)
    slack = bn[rb] * (1 - share) - pb + each
    held = np.flatnonzero(slack + 1e-9 >= bn[rb] * threshold * share)
    top = int(bn.max()) + 1
    key = tb[held] * top + bn[rb[held]]
    order = np.argsort(key, kind="stable")
    key, held = key[order], held[order]
    slack, found = slack[held], rb[held]
    low = np.ceil(an * threshold - 1e-9).astype(np.int64)[ra]
    high = np.minimum(np.floor((an[ra] * (1 - share) - pa_ + each) / share + 1e-9), np.floor(an[ra] / threshold + 1e-9)).astype(np.int64)
    high = np.minimum(high, top - 1)
    some = np.flatnonzero(high >= low)
    ea = ra[some]
    begin = np.searchsorted(key, ta[some] * top + low[some], "left")
    n = np.searchsorted(key, ta[some] * top + high[some], "right") - begin
    behind = np.concatenate([[0], np.cumsum(n)])
    edge, token_edge = np.searchsorted(ea, np.arange(len(an) + 1)), np.concatenate([[0], np.cumsum(an)])
    out = []
    r = 0
    while r < len(an):
        # as many rows at once as keep what meets in bounds, one at least
        until = int(np.searchsorted(behind[edge], behind[edge[r]] + 1_000_000, "right")) - 1
        until = min(max(until, r + 1), r + 256, len(an))
        k = slice(edge[r], edge[until])
        total = int(behind[edge[until]] - behind[edge[r]])
        if total:
            idx = np.arange(total) + np.repeat(begin[k] - (behind[k] - behind[edge[r]]), n[k])
            fits = slack[idx] + 1e-9 >= np.repeat(an[ea[k]] * share, n[k])
            pair = np.sort((np.repeat(ea[k] - r, n[k]) * len(bn))[fits] + found[idx[fits]])
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
            times, pair = np.diff(np.append(first, len(pair))), pair[first]
            x, y = pair // len(bn), pair % len(bn)
            enough = times >= np.minimum(MEET, np.ceil((an[x + r] + bn[y]) * share - 1e-9))
            x, y = x[enough], y[enough]
            mark = np.zeros((until - r) * many, np.bool_)
            mine = slice(token_edge[r], token_edge[until])
            mark[(ra[mine] - r) * many + ta[mine]] = True
            ends = np.cumsum(bn[y])
            at_once = 0
            while at_once < len(y):
                stop = max(at_once + 1, int(np.searchsorted(ends, (ends[at_once - 1] if at_once else 0) + 2_000_000, "right")))
                u, v = x[at_once:stop], y[at_once:stop]
                size = bn[v]
                cum = np.cumsum(size) - size
                seen = mark[np.repeat(u * many, size) + tb[np.arange(int(size.sum())) + np.repeat(start_b[v] - cum, size)]]
                both = np.add.reduceat(seen, cum, dtype=np.int64)
                sim = both / (an[u + r] + size - both)
                like = sim >= threshold
                out.append((u[like] + r, v[like], sim[like]))
                at_once = stop
        r = until
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    x, y, sim = (np.concatenate(c) for c in zip(*out))
    if best is not None and len(x):
        order = np.lexsort((-sim, x))
        x, y, sim = x[order], y[order], sim[order]
        first = np.searchsorted(x, x)
        last = np.minimum(first + best, np.searchsorted(x, x, "right")) - 1
        x, y, sim = (c[sim >= sim[last]] for c in (x, y, sim))
    return x, y, sim


def similar_texts(left: DataFrame, right: DataFrame, threshold: float, best: int | None = None) -> DataFrame:
    """(a_text, b_text, sim) of the distinct texts of two tables (text) whose similarity is ``threshold`` or more.

    Texts of either side are dealt out, and each share of one side meets each share of the other in one task
    (``_close_sets``), whose memory is that of two shares. With ``best`` a text may leave out what is less similar than
    so many others are; equally similar ones stay.
    """
    a, b = (cut(d.select("text").distinct()) for d in (left, right))
    na, nb = a.count(), b.count()
    p = max(1, math.ceil(na / SHARE))
    q = max(1, math.ceil(nb / SHARE), min(2 * left.sparkSession.sparkContext.defaultParallelism, math.ceil(nb / 5_000)))
    sets = lambda d: d.withColumn("g", F.transform(trigrams(F.col("text")), lambda t: F.xxhash64(t))).filter(F.size("g") > 0)
    share = lambda n: F.pmod(F.xxhash64("text"), F.lit(n))
    cells = lambda d, c: sets(d).select("text", "g", F.explode(c).alias("cell")).repartition(p * q, "cell").groupBy("cell")
    x = cells(a, F.transform(F.sequence(F.lit(0), F.lit(q - 1)), lambda j: share(p) * q + j))
    y = cells(b, F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: i * q + share(q)))

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        if not (one.num_rows and other.num_rows):
            return pa.table({"a_text": pa.array([], pa.string()), "b_text": pa.array([], pa.string()), "sim": pa.array([], pa.float64())})
        g, h = (t.column("g").combine_chunks() for t in (one, other))
        flat = lambda c: (c.flatten().to_numpy(zero_copy_only=False), c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        i, j, sim = _close_sets(*flat(g), *flat(h), threshold, best)
        return pa.table({"a_text": one.column("text").take(pa.array(i)), "b_text": other.column("text").take(pa.array(j)), "sim": pa.array(sim, pa.float64())})

    return x.cogroup(y).applyInArrow(run, "a_text string, b_text string, sim double")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_key, right_key, sim) of rows (key, text) whose similarity is ``threshold`` or more, found on distinct texts."""
    return (
        left.select(F.col("key").alias("left_key"), F.col("text").alias("a_text"))
        .join(similar_texts(left, right, threshold), "a_text")
        .join(right.select(F.col("key").alias("right_key"), F.col("text").alias("b_text")), "b_text")
        .select("left_key", "right_key", "sim")
    )

"""Variant spellings of names: a prefix-filtered set-similarity join on words and their grams, verified by soft weighted token similarity.

1. Every name becomes Latin words (``names.words``); equal word lists are one *name*.
2. Words within k errors are found by the pairs of long positional grams they share (``close_words``).
3. A word close to a much more frequent one is that word mistyped. Names meet on the rarest-first prefix of their
   words: words that few rows mention are a name's key words, and names whose key words are equal, close, or close
   to one more frequent spelling are candidates.
4. What frequent words mean is learned from rows that carry a name in two languages (``senses``): words of one
   meaning match, and rows whose subjects differ ("Museum of Salt", "Museum of Toys") are two museums.
5. Candidates are verified by weighted soft similarity: words match equal, corrected, mistyped, abbreviated or as
   initials; a matched word counts by its rarity over all rows.
6. Names without a key word ("Town Museum") meet names of one town or within reach at words that may match, one of them
   among the weightiest of its name, or names of the same letters split otherwise.
7. Names are expanded to rows. Rows far apart are not one museum; pairs of which a name has no key word only link
   rows of one town or within reach.

All work is on distinct names; a name that a third of the rows share is one name until the result is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.geo import EARTH_M, grid, haversine_km, usable
from vitrine.functions.text import fold
from vitrine.llm.confusables import skeleton
from vitrine.llm.names import words
from vitrine.session import cut, release

#: A word mentioned less often (in names, queries and towns) may be a key word: a bound on the names that meet at it.
KEY_MENTIONS = 25
#: A frequent word means another if at least SENSE_SHARE of the rows with both languages say so, SENSE_LEAST rows at
#: least, and SENSE_LIFT times as often as by chance. Words in less than a WORD_SHARE of the rows have no learned meaning.
SENSE_SHARE, SENSE_LEAST, SENSE_LIFT, WORD_SHARE = 0.5, 3, 4.0, 2e-5
#: Least soft similarity of two names of one museum.
SIMILAR = 0.6
#: Least similarity where all key words match and the rows' places agree (names translated, say).
FAINT = 0.3
#: Rows farther apart than this many km are not one museum.
FAR_KM = 45.0
#: Names without a key word link rows of one town, or no farther apart than this many km; and queries so near a row.
PLAIN_KM, QUERY_KM = 3.0, 5.0


def errors(n: Column) -> Column:
    """Typing errors allowed in a word of n letters."""
    return F.when(n >= 8, 2).when(n >= 5, 1).otherwise(0)


def _mention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = b.column("name").to_pylist()
        forms, keys = [], []
        for n in names:
            forms.append(skeleton(n))
            keys.append(" ".join(words(n)))
        yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(forms, pa.string()), pa.array(keys, pa.string())], ["name", "form", "nk"])


def name_forms(names: DataFrame) -> DataFrame:
    """(name, form, nk): the look-alike form and the Latin words of each distinct name; names without a word are left out."""
    return names.select("name").filter("name IS NOT NULL").distinct().mapInArrow(_mention, "name string, form string, nk string").filter("nk <> ''")


def _moves(k: int) -> list[tuple[int, int, int, int, int]]:
    """(delta, i, j, di, dj): how two unharmed segments i < j of k + 2 may lie in a word delta letters longer.

    Errors before, between and behind the two must account for their shifts.
    """
    m = k + 2
    return [
        (delta, i, j, di, dj)
        for delta in range(k + 1) for i in range(m) for j in range(i + 1, m) for di in range(-k, k + 1) for dj in range(-k, k + 1)
        if abs(di) + abs(dj - di) + abs(delta - dj) <= k and (i or not di) and (j < m - 1 or dj == delta)
    ]


def close_words(tokens: DataFrame) -> DataFrame:
    """(t, u, d) with t < u: different words within the errors their shorter length allows.

    The shorter word is cut into k + 2 segments, of which k errors leave two unharmed. Words meet on two segments
    at once, with their places and the length: that is half a word or more, so what meets grows with the words
    and not with their square. ``levenshtein`` verifies. Two neighbouring letters swapped are one error (two to
    ``levenshtein``), so words of 5 to 7 letters also meet their own swaps.
    """
    out = None
    for k, low, high in ((1, 5, 7), (2, 8, None)):
        m = k + 2
        n = F.length("token")
        fits = lambda c: (c >= low) & (c <= high) if high else c >= low
        start = lambda i: F.floor(F.col("n") * i / m).cast("int")
        size = lambda i: start(i + 1) - start(i)
        key = lambda i, j, x, y: F.xxhash64("n", i, j, x, y).alias("key")
        pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(m) for j in range(i + 1, m)))).alias("p")
        held = tokens.filter(fits(n)).select("token", n.alias("n"), pairs).select("token", "n", "p.i", "p.j")
        i, j = F.col("i"), F.col("j")
        held = held.select(F.col("token").alias("t"), F.col("n").alias("nt"), key(i, j, F.col("token").substr(start(i) + 1, size(i)), F.col("token").substr(start(j) + 1, size(j))))
        moves = F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("delta", "i", "j", "di", "dj"), x))) for x in _moves(k)))).alias("p")
        looks = tokens.filter(n >= low).select("token", moves).select("token", "p.*").withColumn("n", F.length("token") - F.col("delta")).filter(fits(F.col("n")))
        inside = (start(i) + F.col("di") >= 0) & (start(j) + F.col("dj") + size(j) <= F.length("token"))
        looks = looks.filter(inside).select(F.col("token").alias("u"), key(i, j, F.col("token").substr(start(i) + 1 + F.col("di"), size(i)), F.col("token").substr(start(j) + 1 + F.col("dj"), size(j))))
        # of two words of one length each looks for the other: one of the meetings is enough
        # exploded sides look small to the planner: never broadcast one of them
        met = held.hint("merge").join(looks, "key").filter((F.length("u") > F.col("nt")) | (F.col("t") < F.col("u")))
        near = met.select("t", "u", F.levenshtein("t", "u", k).alias("d")).filter("d > 0")
        near = near.select(F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"), "d").distinct()
        out = near if out is None else out.unionByName(near)
    short = tokens.filter(F.length("token").between(5, 7)).select(F.col("token").alias("t"))
    swap = lambda i: F.concat(F.col("t").substr(F.lit(1), i - 1), F.col("t").substr(i + 1, F.lit(1)), F.col("t").substr(i, F.lit(1)), F.col("t").substr(i + 2, F.lit(7)))
    swaps = short.select("t", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), swap)).alias("u")).filter("t < u")
    return out.unionByName(swaps.hint("merge").join(short.select(F.col("t").alias("u")), "u").select("t", "u", F.lit(1).alias("d")).distinct())


def _alike(a: str, b: str) -> float:
    """Similarity of two words that aren't equal: abbreviations and initials of one another, else 0."""
    if len(a) > len(b):
        a, b = b, a
    if b.startswith(a):
        return 0.8 if len(a) > 1 else 0.6
    if len(a) >= 3 and a[0] == b[0] and len(a) < len(b):
        at = 0
        for ch in a:
            at = b.find(ch, at) + 1
            if not at:
                return 0.0
        return 0.7 if len(a) * 2 >= len(b) else 0.5
    return 0.0


@lru_cache(300_000)
def bigrams(word: str) -> frozenset[str]:
    return frozenset(word[i : i + 2] for i in range(len(word) - 1))


def grams(word: Column) -> Column:
    """``bigrams`` of a word of more than four letters, else null."""
    return F.when(F.length(word) > 4, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))))


def may_match(a: str, b: str, ga: str, gb: str) -> Column:
    """Whether ``soft_similarity`` may match two words (with their ``grams``): never false where it does.

    Equal, the start of one another, letters of one another in their order, or enough common bigrams.
    """
    short, long = (F.when(F.length(a) <= F.length(b), F.col(x)).otherwise(F.col(y)) for x, y in ((a, b), (b, a)))
    behind = lambda at, c: F.when(at > 0, F.position(c, long, at)).otherwise(0)
    ordered = F.aggregate(F.split(short, ""), F.lit(1), lambda at, c: F.when(behind(at, c) > 0, behind(at, c) + 1).otherwise(0)) > 0
    common, every = F.size(F.array_intersect(ga, gb)), F.size(ga) + F.size(gb)
    likely = (common * 40 >= every * 9) | ((common * 5 >= every) & (F.length(short) >= 8) & (F.length(long) - F.length(short) <= 2))
    opening = F.substring(a, 1, 1) == F.substring(b, 1, 1)
    return (opening & (F.startswith(long, short) | ((F.length(short) > 2) & ordered))) | F.coalesce(likely & F.col(ga).isNotNull() & F.col(gb).isNotNull(), F.lit(False))


@lru_cache(100_000)
def _within_two(a: str, b: str) -> bool:
    """Whether two words are within two errors of each other; only cells two off the diagonal are looked at."""
    n, m = len(a), len(b)
    if abs(n - m) > 2:
        return False
    row = [*range(min(m, 2) + 1), *(3 for _ in range(2, min(m, 4)))]  # columns low .. low + 4 of the row before
    low = 0
    for i in range(1, n + 1):
        first, new = max(0, i - 2), []
        for j in range(first, min(m, i + 2) + 1):
            if not j:
                new.append(i)
                continue
            up = row[j - low] if 0 <= j - low < len(row) else 3
            across = row[j - 1 - low] if 0 <= j - 1 - low < len(row) else 3
            new.append(min(up + 1, across + (a[i - 1] != b[j - 1]), new[-1] + 1 if new else 3, 3))
        if min(new) > 2:
            return False
        row, low = new, first
    return m - low < len(row) and row[m - low] <= 2


def soft_similarity(a: list[tuple[str, float, bool]], b: list[tuple[str, float, bool]]) -> tuple[float, int]:
    """(similarity, level) of two lists of (word, weight, key).

    Words are matched one to one, best first; the similarity is the matched weight over all weight. Level 0: not
    one name, since both have a key word the other lacks, or one lacks the other's heaviest word. Else 1 if a
    key word matched nearly, 2 if all matched key words are equal, 3 if the similarity is SIMILAR or more.
    """
    pairs = []
    # equal words first: what is left over is all that is compared
    at = {y: j for j, (y, _, _) in enumerate(b)}
    equal = {i: at.pop(x) for i, (x, _, _) in enumerate(a) if x in at}
    pairs += [(a[i][1] + b[j][1], 1.0, i, j) for i, j in equal.items()]
    taken = set(equal.values())
    rest = [(j, y, wy, ky, bigrams(y)) for j, (y, wy, ky) in enumerate(b) if j not in taken]
    for i, (x, wx, kx) in enumerate(a):
        if i in equal or not rest:
            continue
        gx = bigrams(x)
        for j, y, wy, ky, gy in rest:
            # words of different openings aren't alike
            s = 1.0 if x == y else _alike(x, y) if x[:1] == y[:1] or not x or not y else 0.0
            if s < 0.5 and len(x) > 4 and len(y) > 4 and not gx.isdisjoint(gy) and (n := 2 * len(gx & gy) / (len(gx) + len(gy))) >= 0.4:
                if n >= (0.62 if kx and ky else 0.45):
                    s = n
                elif len(x) >= 8 and len(y) >= 8 and _within_two(x, y):
                    s = 0.62
            if s >= 0.45:
                pairs.append((s * (wx + wy), s, i, j))
    pairs.sort(reverse=True)
    ui: set[int] = set()
    uj: set[int] = set()
    got = best = 0.0
    exact = keyed = False
    loose = False
    for _, s, i, j in pairs:
        if i in ui or j in uj:
            continue
        ui.add(i)
        uj.add(j)
        got += s * (a[i][1] + b[j][1])
        best = max(best, a[i][1], b[j][1])
        if a[i][2] or b[j][2]:
            keyed = True
            exact = exact or s == 1.0
            loose = loose or s < 1.0
    total = sum(w for _, w, _ in a) + sum(w for _, w, _ in b)
    if not total:
        return 0.0, 0
    sim = got / total
    ua = max((w for i, (_, w, k) in enumerate(a) if k and i not in ui), default=0.0)
    ub = max((w for j, (_, w, k) in enumerate(b) if k and j not in uj), default=0.0)
    if (ua and ub) or max(ua, ub) > best:
        return sim, 0
    if sim >= SIMILAR:
        return sim, 3
    if keyed and not ua and not ub and sim >= FAINT:
        return sim, 2 if exact and not loose else 1
    return sim, 0


def senses(rows: DataFrame, info: DataFrame, places: DataFrame) -> DataFrame:
    """(token, senses): what frequent words mean, as the frequent words that stand in another name of the same row instead.

    ``rows``: (id, own, other), the word lists of a row's name and of one of its aliases; ``info``: (token, word) of
    frequent words and their typings; ``places``: words of towns, which mean nothing. The words a name has and the
    alias lacks are counted against the words the alias has and the name lacks; words that mean one another stand
    together far more often than by chance. A word that others mean means itself. WORD_SHARE bounds the words counted.
    """
    usual = info.join(places.select("token"), "token", "left_anti").select("token", "word")
    split = lambda c: F.array_distinct(F.split(c, " "))
    pairs = rows.filter("own <> other").select("own", "other", F.xxhash64("own", "other").alias("pid")).groupBy("own", "other", "pid").agg(F.count(F.lit(1)).alias("n"))
    left = pairs.select("pid", "n", F.explode(F.array_except(split("own"), split("other"))).alias("token")).join(usual, "token").select("pid", "n", F.col("word").alias("w")).distinct()
    right = pairs.select("pid", F.explode(F.array_except(split("other"), split("own"))).alias("token")).join(usual, "token").select("pid", F.col("word").alias("v")).distinct()
    both = cut(left.join(right, "pid").filter("w <> v"))
    near = both.groupBy("w", "v").agg(F.sum("n").alias("k")).filter(F.col("k") >= SENSE_LEAST)
    lefts = both.select("pid", "n", "w").distinct().groupBy("w").agg(F.sum("n").alias("nw"))
    rights = both.select("pid", "n", "v").distinct().groupBy("v").agg(F.sum("n").alias("nv"))
    total = both.select("pid", "n").distinct().agg(F.sum("n").alias("all"))
    sure = near.join(lefts, "w").join(rights, "v").crossJoin(F.broadcast(total)).filter((F.col("k") >= SENSE_SHARE * F.col("nw")) & (F.col("k") * F.col("all") >= SENSE_LIFT * F.col("nw") * F.col("nv")))
    held = sure.select("w", F.struct((F.col("k") / F.col("nw")).alias("share"), (F.col("k") / F.col("nv")).alias("lift"), F.col("v").alias("v")).alias("s"))
    meant = sure.select(F.col("v").alias("w"), F.struct(F.lit(2.0).alias("share"), F.lit(0.0).alias("lift"), F.col("v").alias("v")).alias("s")).distinct()
    of = held.unionByName(meant).groupBy("w").agg(F.reverse(F.array_sort(F.collect_set("s"))).alias("s"))
    # a word that others mean keeps to itself
    return of.select(F.col("w").alias("token"), F.when(F.col("s")[0].share == 2.0, F.array("w")).otherwise(F.transform("s", lambda x: x.v)).alias("senses"))


@lru_cache(20_000)
def _shape_of(code: str) -> tuple[tuple[str, float, bool], ...]:
    """(word, weight, key) of each word in a name's code, as ``Names.scored`` writes it."""
    return tuple((w, float(x), k == "true") for w, x, k in (part.split(":") for part in code.split(" ")))


class Names:
    """Distinct names, their words, and how the words hang together."""

    def __init__(self, forms: DataFrame, mentions: DataFrame, places: DataFrame, called: DataFrame):
        """``forms``: nk of every name; ``mentions``: (nk, n) how many rows and queries use it; ``places``: (token, df) of
        words that name towns, which are no key words; ``called``: (id, own, other), the names and aliases of rows."""
        nodes = cut(mentions.groupBy("nk").agg(F.sum("n").alias("n")))
        total = nodes.agg(F.sum("n")).collect()[0][0] or 0
        each = nodes.select("nk", "n", F.posexplode(F.split("nk", " ")).alias("pos", "token"))
        own = each.select("nk", "n", "token").distinct().groupBy("token").agg(F.sum("n").alias("df"))
        own = own.join(places.withColumnRenamed("df", "dp"), "token", "left")
        tokens = cut(own.select("token", (F.col("df") + F.coalesce("dp", F.lit(0))).alias("df")))
        close = cut(close_words(tokens))
        release(close.sparkSession)
        both = close.unionByName(close.select(F.col("u").alias("t"), F.col("t").alias("u"), "d"))
        df_of = tokens.select(F.col("token").alias("u"), F.col("df").alias("du"))
        # the much more frequent word a word is a typing of
        better = both.join(df_of.filter(F.col("du") >= KEY_MENTIONS), "u").join(tokens.select(F.col("token").alias("t"), F.col("df").alias("dt")), "t").filter("du >= 10 * dt")
        fixed = better.groupBy("t").agg(F.max_by(F.struct("u", "du"), F.struct(-F.col("d"), "du", "u")).alias("f")).select(F.col("t").alias("token"), F.col("f.u").alias("as"), F.col("f.du").alias("das"))
        usual = tokens.join(fixed, "token", "left").select("token", "df", F.coalesce("as", "token").alias("word"), F.coalesce("das", "df").alias("dw"), F.col("as").isNotNull().alias("mended"))
        usual = cut(usual)
        meaning = senses(called, usual.filter(F.col("dw") >= max(KEY_MENTIONS, total * WORD_SHARE)), places).select(F.col("token").alias("word"), "senses")
        info = usual.join(meaning, "word", "left").select(
            "token", "df", F.coalesce(F.col("senses")[0], F.col("word")).alias("word"), F.coalesce("senses", F.array().cast("array<string>")).alias("senses"),
            F.log(F.lit(float(total + 1)) / F.col("dw")).alias("weight"),
            (~F.col("mended") & (F.col("df") < KEY_MENTIONS) & (F.length("token") >= 5)).alias("key"),
        )
        self.info = cut(info)
        release(info.sparkSession)
        keys = self.info.filter("key").select("token", "df")
        linked = cut(both.join(keys.select(F.col("token").alias("t")), "t", "left_semi").join(keys.select(F.col("token").alias("u"), F.col("df").alias("du")), "u"))
        hub = linked.select("t", F.struct("du", "u").alias("h")).unionByName(keys.select(F.col("token").alias("t"), F.struct(F.col("df").alias("du"), F.col("token").alias("u")).alias("h")))
        self.hubs = hub.groupBy("t").agg(F.max("h").alias("h")).select(F.col("t").alias("token"), F.col("h.u").alias("hub"))
        self.linked = linked.filter("t < u").select("t", "u")
        self.each = each
        shaped = each.join(self.info, "token").groupBy("nk").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "weight", "key", "senses"))).alias("w"))
        self.shaped = cut(shaped.select(
            "nk", F.transform("w", lambda x: F.struct(x.word.alias("word"), x.weight.alias("weight"), x.key.alias("key"))).alias("w"), F.exists("w", lambda x: x.key).alias("keyed"),
            F.array_sort(F.array_distinct(F.flatten(F.transform("w", lambda x: x.senses)))).alias("senses"),
        ))
        self.postings = cut(each.join(keys.select("token"), "token", "left_semi").select("nk", "token").distinct())

    def candidates(self) -> DataFrame:
        """(a, b) with a < b: different names whose key words meet; a pair may come more than once."""
        p = self.postings
        hubbed = p.join(self.hubs, "token").select("nk", "hub").distinct()
        same = hubbed.select("hub", F.col("nk").alias("a")).join(hubbed.select("hub", F.col("nk").alias("b")), "hub").filter("a < b").select("a", "b")
        x = self.linked.join(p.select(F.col("token").alias("t"), F.col("nk").alias("a")), "t").join(p.select(F.col("token").alias("u"), F.col("nk").alias("b")), "u").filter("a <> b")
        return same.unionByName(x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    def spelt(self) -> DataFrame:
        """(nk, keyed, word, first): the words of each name, and whether they come first.

        A matched pair of words counts at most its own weight, so where two names are SIMILAR the matched words of one of
        them hold that share of its weight: its heaviest one has so much weight from it on. Where less than SIMILAR will
        do, all key words are matched. So names above either bound match at a word that is first in one of them.
        """
        ws = F.array_sort(F.transform("w", lambda x: F.struct((-x.weight).alias("low"), x.word.alias("word"), x.key.alias("key"))))
        s = self.shaped.select("nk", "keyed", ws.alias("ws"))
        above = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t - F.least(x.low, F.lit(0.0)))
        least = F.aggregate("ws", F.lit(0.0), lambda t, x: t - x.low) * SIMILAR - 1e-9
        each = F.transform("ws", lambda x, i: F.struct(x.word.alias("word"), (x.key | (above(F.slice("ws", i + 1, F.size("ws"))) >= least)).alias("first")))
        return s.select("nk", "keyed", F.explode(each).alias("x")).groupBy("nk", "keyed", "x.word").agg(F.bool_or("x.first").alias("first"))

    def keyless_candidates(self, spots: tuple[DataFrame, DataFrame], near_queries: tuple[DataFrame, DataFrame]) -> DataFrame:
        """(a, b) with a < b: different names, one of them at least without a key word, that meet in a place.

        ``spots``: (nk, at) of museums, as they look for others and as they are found; ``near_queries``: (nk, at) of
        museums and of queries. In a place the words of names without a key word meet all words; what may match brings
        the names together.
        """
        spelt = cut(self.spelt())
        plain = spelt.filter("NOT keyed")
        m, q = near_queries
        # all kinds of places in one plan, told apart by their first letter: three plans alike cost the driver thrice the memory
        kinds = lambda *sides: reduce(DataFrame.unionByName, (d.select("nk", F.concat(F.lit(k), "at").alias("at")) for k, d in zip("smq", sides))).distinct()
        looks, held = kinds(spots[0], m, q), kinds(spots[1], q, m)
        x = cut(looks.join(plain, "nk").select("at", F.col("nk").alias("x"), F.col("word").alias("u"), F.col("first").alias("fx")))
        y = held.join(x.select("at").distinct(), "at", "left_semi").join(spelt, "nk")
        y = cut(y.select("at", F.col("nk").alias("y"), F.col("word").alias("v"), F.col("first").alias("fy")))
        us, vs = (d.groupBy("at", c).agg(F.bool_or(f).alias(f), grams(F.col(c)).alias(f"g{c}")) for d, c, f in ((x, "u", "fx"), (y, "v", "fy")))
        like = cut(us.hint("merge").join(vs, "at").filter("fx OR fy").filter(may_match("u", "v", "gu", "gv")).select("at", "u", "v"))
        release(like.sparkSession)
        # two joins: words that are first in neither name bring nothing together
        met = (xs.hint("merge").join(like, ["at", "u"]).join(ys, ["at", "v"]).select("x", "y") for xs, ys in ((x.filter("fx"), y), (x.filter("NOT fx"), y.filter("fy"))))
        out = reduce(DataFrame.unionByName, met)
        bare = self.shaped.select("nk", "keyed", F.replace("nk", F.lit(" "), F.lit("")).alias("letters"))
        split = bare.filter("NOT keyed").select("letters", F.col("nk").alias("x")).hint("merge").join(bare.select("letters", F.col("nk").alias("y")), "letters").select("x", "y")
        return out.unionByName(split).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def scored(self, pairs: DataFrame) -> DataFrame:
        """(a, b, sim, level) of candidate pairs."""
        # as texts: names come again and again, and a text is taken apart once
        code = F.array_join(F.transform("w", lambda x: F.concat_ws(":", x.word, x.weight.cast("string"), x.key.cast("string"))), " ")
        s = self.shaped.select("nk", code.alias("w"))
        full = pairs.join(s.select(F.col("nk").alias("a"), F.col("w").alias("wa")), "a").join(s.select(F.col("nk").alias("b"), F.col("w").alias("wb")), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sims, levels = [], []
                for p, q, x, y in zip(*(b.column(c).to_pylist() for c in ("a", "b", "wa", "wb"))):
                    s1, s2 = (1.0, 3) if p.replace(" ", "") == q.replace(" ", "") else soft_similarity(_shape_of(x), _shape_of(y))
                    sims.append(s1)
                    levels.append(s2)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sims, pa.float64()), pa.array(levels, pa.int32())], ["a", "b", "sim", "level"])

        return full.select("a", "b", "wa", "wb").mapInArrow(run, "a string, b string, sim double, level int")


def _spot(c: str) -> Column:
    return F.when(usable(F.col("location.lat"), F.col("location.lon")), F.col(f"location.{c}")).alias(c)


def p4_found(museums: DataFrame, places: DataFrame) -> DataFrame:
    """(kind, id_a, id_b): 'rows' of one museum spelt differently (smaller id first), and ('query', museums id, place_id).

    Null and blank names take part in nothing; names that differ by look-alike characters alone aren't different
    spellings; repeated rows count once; extra columns are ignored. Aliases help to link, but only names count as
    spellings.
    """
    m = museums.filter("id IS NOT NULL").select(
        "id", "name", F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("every"), _spot("lat"), _spot("lon"), fold(F.col("locality")).alias("town")
    )
    q = places.filter("place_id IS NOT NULL").select(F.col("place_id").alias("id"), F.col("query").alias("name"), _spot("lat"), _spot("lon"))
    called = m.select("id", F.explode("every").alias("called"))
    forms = cut(name_forms(called.select(F.col("called").alias("name")).unionByName(q.select("name"))))
    towns = m.filter("town <> ''").select(F.explode(F.split("town", " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    named = cut(called.join(forms.select(F.col("name").alias("called"), "nk"), "called").select("id", "nk").distinct())
    mine = cut(m.join(forms.select("name", "form", "nk"), "name").select("id", "form", F.col("nk").alias("own"), "lat", "lon", "town"))
    pairs = mine.select("id", "own").distinct().join(named.select("id", F.col("nk").alias("other")), "id")
    mentions = named.groupBy("nk").agg(F.count(F.lit(1)).alias("n")).unionByName(q.join(forms, "name").groupBy("nk").agg(F.count(F.lit(1)).alias("n")))
    names = Names(forms, mentions, towns, pairs)
    # the driver keeps little of each step; what it is done with would else pile up, and the shuffles of it on disk
    release(museums.sparkSession)

    # a class is one written form of a name, under one of the words it is called by, with what the row's names mean
    senses_of = names.shaped.filter("size(senses) > 0").select("nk", "senses")
    subjects = named.join(senses_of, "nk").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("senses")))).alias("subject"))
    own = mine.join(mine.select("id", F.col("own").alias("nk")).join(senses_of, "nk").select("id", F.col("senses").alias("said")), "id", "left").join(subjects, "id", "left")
    own = own.select("id", "form", "lat", "lon", "town", F.coalesce("said", "subject", F.array().cast("array<string>")).alias("subject"))
    rows = cut(own.join(named, "id").withColumn("cid", F.xxhash64("nk", "form", "subject")))
    classes_of = cut(rows.select("nk", "form", "cid", "subject").distinct())
    asked = cut(q.join(forms, "name").select(F.col("id").alias("place_id"), F.col("nk").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("ob")).join(names.shaped.select(F.col("nk").alias("b"), F.col("senses").alias("sb")), "b"))
    mk = cut(classes_of.select("nk").distinct())
    release(museums.sparkSession)

    # without a key word the town, or a place within reach, joins in: unrelated rows never meet
    places_of = lambda d, t, la, lo, around: d.withColumn("at", F.explode(F.concat(F.when(F.col(t) != "", F.array(F.concat(F.lit("t"), t))).otherwise(F.array().cast("array<string>")), F.transform(grid(F.col(la), F.col(lo), PLAIN_KM, around), lambda c: F.concat(F.lit("g"), c)))))
    spots = tuple(places_of(rows, "town", "lat", "lon", around) for around in (True, False))
    near_queries = rows.select("nk", F.explode(grid(F.col("lat"), F.col("lon"), QUERY_KM, False)).alias("at")), asked.select(F.col("b").alias("nk"), F.explode(grid(F.col("lb"), F.col("ob"), QUERY_KM, True)).alias("at"))
    keyless = cut(names.keyless_candidates(spots, near_queries))
    release(museums.sparkSession)
    pairs = names.candidates().unionByName(keyless).distinct()
    # two queries are never linked: one of the names must be a museum's
    held = mk.select(F.col("nk").alias("a"), F.lit(True).alias("ha")), mk.select(F.col("nk").alias("b"), F.lit(True).alias("hb"))
    pairs = pairs.join(held[0], "a", "left").join(held[1], "b", "left").filter("ha OR hb").select("a", "b")
    close = names.scored(pairs).filter("level > 0").select("a", "b", "level")
    close = cut(close)
    release(museums.sparkSession)
    keyed = names.shaped.select(F.col("nk").alias("a"), "keyed")
    linked = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "level"))
    linked = linked.unionByName(mk.select(F.col("nk").alias("a"), F.col("nk").alias("b"), F.lit(3).alias("level")))
    linked = cut(linked.join(keyed, "a").join(keyed.select(F.col("a").alias("b"), F.col("keyed").alias("kb")), "b").select("a", "b", "level", (F.col("keyed") & F.col("kb")).alias("keyed")))

    # one subject holds the other, or says nothing: "art" and "modern art", but not "folk art" and "modern art"
    agree = (F.size(F.array_except("sa", "sb")) == 0) | (F.size(F.array_except("sb", "sa")) == 0)
    ca = classes_of.select(F.col("nk").alias("a"), F.col("form").alias("fa"), F.col("cid").alias("ca"), F.col("subject").alias("sa"))
    cb = classes_of.select(F.col("nk").alias("b"), F.col("form").alias("fb"), F.col("cid").alias("cb"), F.col("subject").alias("sb"))
    classes = cut(linked.join(ca, "a").join(cb, "b").filter("fa <> fb AND ca < cb").filter(agree).groupBy("ca", "cb").agg(F.max("level").alias("level"), F.max("keyed").alias("keyed")))
    release(museums.sparkSession)
    ra = rows.select(F.col("cid").alias("ca"), F.col("id").alias("ia"), F.col("lat").alias("la"), F.col("lon").alias("oa"), F.col("town").alias("ta"))
    rb = rows.select(F.col("cid").alias("cb"), F.col("id").alias("ib"), F.col("lat").alias("lb"), F.col("lon").alias("ob"), F.col("town").alias("tb"))
    km = haversine_km(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob"), EARTH_M / 1000)
    fits = F.when(F.col("level") == 3, F.coalesce(km <= FAR_KM, F.lit(True))).otherwise(F.coalesce(km <= FAR_KM, (F.col("ta") == F.col("tb")) & (F.col("ta") != ""), F.lit(False)))
    with_key = classes.filter("keyed").join(ra, "ca").join(rb, "cb").filter(fits)
    plain = classes.filter("NOT keyed").join(places_of(ra, "ta", "la", "oa", True), "ca")
    plain = plain.join(places_of(rb, "tb", "lb", "ob", False), ["cb", "at"]).filter(F.coalesce(km <= PLAIN_KM, F.lit(True)))
    found = with_key.select("ia", "ib").unionByName(plain.select("ia", "ib")).filter("ia <> ib")
    found = found.select(F.lit("rows").alias("kind"), F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()

    hits = linked.join(asked, "b").join(rows.select(F.col("nk").alias("a"), "id", F.col("lat").alias("la"), F.col("lon").alias("oa"), F.col("subject").alias("sa")), "a").filter(agree)
    near = F.coalesce(km <= FAR_KM, F.col("level") >= 2)
    queries = hits.filter(F.when(F.col("keyed"), near).otherwise(F.coalesce(km <= QUERY_KM, F.lit(False))))
    return found.unionByName(queries.select(F.lit("query").alias("kind"), F.col("id").alias("id_a"), F.col("place_id").alias("id_b")).distinct())

"""String distances and similarities.

Those that built-in functions can express are Column expressions; the dynamic programs are plain Python
inside of Arrow-batched pandas UDFs, each computed once per distinct pair of a batch.  Null on either
side gives null; equal strings have distance 0 and similarity 1.

A shingle profile counts all windows of k characters after runs of white space became one space.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- profiles


def profile(s: str, k: int) -> Counter:
    s = re.sub(r"\s+", " ", s)
    return Counter(s[i : i + k] for i in range(len(s) - k + 1))


def shingles(c: Column, k: int) -> Column:
    """All windows of k characters as an array (empty if there is none)."""
    s = F.regexp_replace(c, r"\s+", " ")
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def _sets(a: Column, b: Column, k: int) -> tuple[Column, Column, Column]:
    x, y = F.array_distinct(shingles(a, k)), F.array_distinct(shingles(b, k))
    return F.size(x).cast("double"), F.size(y).cast("double"), F.size(F.array_intersect(x, y)).cast("double")


def jaccard_column(a: Column, b: Column, k: int = 3) -> Column:
    n, m, both = _sets(a, b, k)
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when((F.length(a) < k) | (F.length(b) < k), 0.0).otherwise(F.coalesce(F.try_divide(both, n + m - both), F.lit(0.0)))


def dice_column(a: Column, b: Column, k: int = 3) -> Column:
    n, m, both = _sets(a, b, k)
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).otherwise(F.coalesce(F.try_divide(2 * both, n + m), F.lit(0.0)))


def overlap_column(a: Column, b: Column, k: int = 3) -> Column:
    n, m, both = _sets(a, b, k)
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when((F.length(a) < k) | (F.length(b) < k), 0.0).otherwise(F.coalesce(F.try_divide(both, F.least(n, m)), F.lit(0.0)))


def _count(shingle_list: Column, x: Column) -> Column:
    return F.size(F.filter(shingle_list, lambda y: y == x))


def qgram_column(a: Column, b: Column, k: int = 3) -> Column:
    x, y = shingles(a, k), shingles(b, k)
    total = F.aggregate(F.array_union(x, y), F.lit(0), lambda acc, s: acc + F.abs(_count(x, s) - _count(y, s)))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 0).otherwise(total)


def cosine_column(a: Column, b: Column, k: int = 3) -> Column:
    x, y = shingles(a, k), shingles(b, k)
    dot = F.aggregate(F.array_intersect(x, y), F.lit(0.0), lambda acc, s: acc + _count(x, s) * _count(y, s))
    norm = lambda z: F.sqrt(F.aggregate(F.array_distinct(z), F.lit(0.0), lambda acc, s: acc + F.pow(_count(z, s), F.lit(2))))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when((F.length(a) < k) | (F.length(b) < k), 0.0).otherwise(F.try_divide(dot, norm(x) * norm(y)))


def levenshtein_column(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def normalized_levenshtein_column(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


# ---------------------------------------------------------------- plain versions


def levenshtein(a: str, b: str) -> float:
    return weighted_levenshtein(a, b)


def weighted_levenshtein(a: str, b: str, insert=lambda c: 1.0, delete=lambda c: 1.0, replace=lambda x, y: 1.0) -> float:
    """Least cost of edits that make a into b."""
    row = [0.0]
    for y in b:
        row.append(row[-1] + insert(y))
    for x in a:
        gone = delete(x)
        new = [row[0] + gone]
        for j, y in enumerate(b):
            new.append(min(row[j] + (replace(x, y) if x != y else 0.0), row[j + 1] + gone, new[j] + insert(y)))
        row = new
    return row[-1]


def damerau(a: str, b: str) -> float:
    """Unrestricted: a swap of characters counts one, also with edits between them."""
    far = len(a) + len(b)
    table = {(-1, -1): far}
    for i in range(len(a) + 1):
        table[i, -1], table[i, 0] = far, i
    for j in range(len(b) + 1):
        table[-1, j], table[0, j] = far, j
    last_row: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        last_column = 0
        for j, y in enumerate(b, 1):
            i0, j0 = last_row.get(y, 0), last_column
            best = min(table[i - 1, j - 1] + (x != y), table[i, j - 1] + 1, table[i - 1, j] + 1)
            table[i, j] = min(best, table[i0 - 1, j0 - 1] + (i - i0 - 1) + 1 + (j - j0 - 1))
            if x == y:
                last_column = j
        last_row[x] = i
    return float(table[len(a), len(b)])


def optimal_string_alignment(a: str, b: str, compat: bool = False) -> float:
    """Damerau with no edit inside of a swap.  compat: an empty first string is at distance 0."""
    if compat and not a:
        return 0.0
    older, old = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            cost = int(a[i - 1] != b[j - 1])
            best = min(old[j - 1] + cost, row[j - 1] + 1, old[j] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, older[j - 2] + cost)
            row.append(best)
        older, old = old, row
    return float(old[-1])


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def lcs_distance(a: str, b: str) -> float:
    return float(len(a) + len(b) - 2 * lcs_length(a, b))


def metric_lcs(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 - lcs_length(a, b) / longest if longest else 0.0


def jaro_winkler(a: str, b: str, threshold: float = 0.7) -> float:
    """Similarity.  The prefix bonus has no cap on the prefix, and its weight is min(0.1, 1 / longer)."""
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    reach = int(max(len(long) / 2 - 1, 0))
    free, matched = [True] * len(long), []
    for i, c in enumerate(short):
        hit = next((j for j in range(max(0, i - reach), min(len(long), i + reach + 1)) if free[j] and long[j] == c), None)
        if hit is not None:
            free[hit] = False
            matched.append(c)
    if not matched:
        return 0.0
    other = [c for c, f in zip(long, free, strict=True) if not f]
    m, swaps = len(matched), sum(x != y for x, y in zip(matched, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= threshold:
        return jaro
    common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(short))
    return jaro + min(0.1, 1.0 / len(long)) * common * (1 - jaro)


#: Longest strings that jaro_winkler_batch() takes together; longer ones are compared one pair at a time.
BATCH_LENGTH = 64


def jaro_winkler_batch(a: list[str], b: list[str], threshold: float = 0.7) -> np.ndarray:
    """jaro_winkler() of many pairs of strings of at most BATCH_LENGTH characters, step by step over all of them."""
    n = len(a)
    if not n:
        return np.zeros(0)
    na, nb = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    width = max(1, int(na.max()), int(nb.max()))
    x, y = (np.array(s, f"U{width}").view(np.uint32).reshape(n, width) for s in (a, b))
    same = (na == nb) & (x == y).all(1)
    turned = na > nb  # the shorter one walks along the longer one
    short, long = np.where(turned[:, None], y, x), np.where(turned[:, None], x, y)
    ns, nl = np.minimum(na, nb), np.maximum(na, nb)
    reach = np.maximum(nl / 2 - 1, 0).astype(np.int64)
    places = np.arange(width)
    free = places < nl[:, None]
    inside, widest, even = places < ns[:, None], int(reach.max()), bool((reach == reach[0]).all())
    matched = np.zeros((n, width), bool)
    every = np.arange(n)
    for i in range(int(ns.max())):
        low, high = max(0, i - widest), min(width, i + widest + 1)
        hit = (long[:, low:high] == short[:, i : i + 1]) & free[:, low:high]
        hit &= inside[:, i : i + 1] if even else inside[:, i : i + 1] & (np.abs(places[low:high] - i) <= reach[:, None])
        at = hit.argmax(1)
        found = hit[every, at]
        matched[:, i] = found
        free[every[found], low + at[found]] = False
    taken = (places < nl[:, None]) & ~free
    m = matched.sum(1)
    one, other = np.zeros((2, n, width), np.uint32)
    for out, flags, chars in ((one, matched, short), (other, taken, long)):
        row, column = np.nonzero(flags)
        out[row, (np.cumsum(flags, 1) - 1)[row, column]] = chars[row, column]
    swaps = (one != other).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / na + m / nb + (m - swaps) / m) / 3
        differ = (x != y) | (places >= ns[:, None])
        common = np.where(differ.any(1), differ.argmax(1), width)
        value = np.where(jaro <= threshold, jaro, jaro + np.minimum(0.1, 1.0 / nl) * common * (1 - jaro))
    return np.where(same, 1.0, np.where(m > 0, value, 0.0))


def ngram_distance(a: str, b: str, n: int = 2, compat: bool = False) -> float:
    """Kondrak's n-gram distance with padded starts.  Strings shorter than n are compared position by
    position; compat gives the share that agrees there instead of the share that differs."""
    if a == b:
        return 0.0
    if not a or not b:
        return 1.0
    longest = max(len(a), len(b))
    if min(len(a), len(b)) < n:
        same = sum(x == y for x, y in zip(a, b, strict=False))
        return same / longest if compat else 1.0 - same / longest
    pad = "\n" * (n - 1)
    x, y = pad + a, pad + b
    row = [float(i) for i in range(len(a) + 1)]
    for j in range(1, len(b) + 1):
        gram, new = y[j - 1 : j - 1 + n], [float(j)]
        for i in range(1, len(a) + 1):
            own = x[i - 1 : i - 1 + n]
            differ = sum(p != q for p, q in zip(own, gram, strict=True))
            weight = n - sum(p == q == "\n" for p, q in zip(own, gram, strict=True))
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + differ / weight))
        row = new
    return row[-1] / longest


def cosine(a: str, b: str, k: int = 3) -> float:
    if a == b:
        return 1.0
    if min(len(a), len(b)) < k:
        return 0.0
    x, y = profile(a, k), profile(b, k)
    norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return sum(v * y[s] for s, v in x.items()) / norm if norm else 0.0


def _share(a: str, b: str, k: int, whole, guard: bool = True) -> float:
    if a == b:
        return 1.0
    if guard and min(len(a), len(b)) < k:
        return 0.0
    x, y = set(profile(a, k)), set(profile(b, k))
    base = whole(x, y)
    return len(x & y) / base if base else 0.0


def jaccard(a: str, b: str, k: int = 3) -> float:
    return _share(a, b, k, lambda x, y: len(x | y))


def overlap_coefficient(a: str, b: str, k: int = 3) -> float:
    return _share(a, b, k, lambda x, y: min(len(x), len(y)))


def sorensen_dice(a: str, b: str, k: int = 3) -> float:
    return _share(a, b, k, lambda x, y: (len(x) + len(y)) / 2, guard=False)


def qgram(a: str, b: str, k: int = 3) -> float:
    if a == b:
        return 0.0
    x, y = profile(a, k), profile(b, k)
    return float(sum(abs(x[s] - y[s]) for s in x | y))


# ---------------------------------------------------------------- sift4


def character_frequency(s: str) -> list[int]:
    return [s.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"]


TOKENIZERS = {"characters": list, "words": str.split, "frequency": character_frequency}


def _aligned(s: list, t: list, reach: int, same) -> Iterator[tuple[tuple[int, int] | None, int]]:
    """Walks both token lists at once.  Yields, for each step, the pair of positions that matched (None where
    a run of matches was broken off) and how far the walk has come; (None, 0) says that the shorter list ended.

    Where tokens differ, the walk goes on from the nearest pair, at most `reach` ahead on one side, that matches.
    """
    here = (0, 0)

    def alive(place):
        return place[0] < len(s) and place[1] < len(t)

    while alive(here):
        matched = here if same(s[here[0]], t[here[1]]) else None
        if matched:
            here = (here[0] + 1, here[1] + 1)
        else:
            start = min(here)
            ahead = ((start + far * left, start + far * (1 - left)) for far in range(reach) for left in (1, 0))
            here = next((p for p in ahead if alive(p) and same(s[p[0]], t[p[1]])), (start + 1, start + 1))
        yield matched, max(here)
        if not alive(here):
            here = (min(here), min(here))
            yield None, 0


class _Crossings:
    """Matches that a later one may cross.  A crossing is charged once, to the match that strays further from
    the diagonal."""

    def __init__(self):
        self.places: list[tuple[int, int]] = []
        self.charged: list[bool] = []

    def add(self, i: int, j: int) -> tuple[int, int] | None:
        """Takes a match in; the match that pays for a crossing, if there is one to pay for."""
        across = next((n for n, (x, y) in enumerate(self.places) if i <= x or j <= y), None)
        older = len(self.places) if across is None else across
        open_ = [n for n, (x, y) in enumerate(self.places) if n >= older or i <= y or j <= x]
        payer, own = None, False
        if across is not None:
            x, y = self.places[across]
            own = abs(j - i) >= abs(y - x)
            if own or not self.charged[across]:
                payer = (i, j) if own else (x, y)
            self.charged[across] = self.charged[across] or not own
        self.places = [self.places[n] for n in open_] + [(i, j)]
        self.charged = [self.charged[n] for n in open_] + [own]
        return payer


def sift4(a: str, b: str, reach: int = 5, limit: float = 0, tokens="characters", match=lambda x, y: x == y, worth=lambda x, y: 1, length=lambda n: n, swap_cost=lambda i, j: 1, total=lambda common, swaps: common - swaps) -> int:
    """Approximate distance: the longer list's length less what one pass with a bounded look ahead finds in
    common, runs of matches counted by `length`, crossings (swaps) by `swap_cost`.  limit: gives up there."""
    split = TOKENIZERS[tokens] if isinstance(tokens, str) else tokens
    s, t = split(a), split(b)
    if not s or not t:
        return len(s) or len(t)
    crossings, common, run, swaps = _Crossings(), 0, 0, 0
    for matched, reached in _aligned(s, t, reach, match):
        if matched:
            run += worth(s[matched[0]], t[matched[1]])
            payer = crossings.add(*matched)
            swaps += swap_cost(*payer) if payer else 0
        else:
            common, run = common + length(run), 0
        if limit and reached and (so_far := length(reached) - total(common, swaps)) >= limit:
            return round(so_far)
    return round(length(max(len(s), len(t))) - total(common + length(run), swaps))


# ---------------------------------------------------------------- vectors of metrics

#: The order of the sixteen: fixed values.
NAMES16 = ("cosine1", "damerau", "jaccard2", "overlap3", "jaro_winkler", "levenshtein", "lcs", "metric_lcs", "ngram2", "normalized_levenshtein", "osa", "overlap2", "qgram2", "dice2", "weighted_levenshtein", "overlap1")


#: Measures that no built-in function gives; a vector fetches all it needs of them in one call.
PROGRAMS = {"damerau": damerau, "jaro_winkler": jaro_winkler, "lcs": lcs_distance, "ngram": functools.partial(ngram_distance, n=2, compat=True), "osa": optimal_string_alignment, "osa_compat": functools.partial(optimal_string_alignment, compat=True)}


def token_similarities(x: str, y: str) -> list[float]:
    """Four similarities of two tokens, by edits, Jaro-Winkler, common subsequence and aligned edits; blank tokens
    are alike or not at all."""
    if not (x and y):
        return 4 * [float(x == y)]
    share = lambda d, n: 1 - d / n
    longest = max(map(len, (x, y)))
    return [share(levenshtein(x, y), longest), jaro_winkler(x, y), share(lcs_distance(x, y), len(x) + len(y)), share(optimal_string_alignment(x, y), longest)]


def vector4(a: list[str], b: list[str]) -> list[float]:
    """token_similarities() of all pairs of tokens at the same place."""
    return [v for pair in zip(a, b, strict=False) for v in token_similarities(*pair)]


# ---------------------------------------------------------------- as functions of columns

METRICS = {f.__name__: f for f in (levenshtein, weighted_levenshtein, damerau, optimal_string_alignment, lcs_distance, metric_lcs, jaro_winkler, ngram_distance, cosine, jaccard, overlap_coefficient, sorensen_dice, qgram, sift4)}


def _over_pairs(f, a: pd.Series, b: pd.Series) -> pd.Series:
    known = functools.lru_cache(100_000)(f)
    return pd.Series([None if x is None or y is None else known(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def _jaro_winkler_column(f):
    """f, a jaro_winkler() with its options, of two string columns."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(object), b.to_numpy(object)
        out = np.full(len(x), np.nan)
        both = np.flatnonzero(~(a.isna() | b.isna()).to_numpy())
        short = np.array([len(x[i]) <= BATCH_LENGTH and len(y[i]) <= BATCH_LENGTH for i in both], bool)
        for i in both[~short]:
            out[i] = f(x[i], y[i])
        some = both[short]
        for at in np.split(some, range(4096, len(some), 4096)):  # as much as a cache holds
            out[at] = jaro_winkler_batch(x[at].tolist(), y[at].tolist(), **f.keywords)
        return pd.Series(out).where(pd.Series(np.isin(np.arange(len(x)), both)))

    return run


def metric(name: str, **options):
    """A function of two string columns; options go to the metric."""
    f = functools.partial(METRICS[name], **options)
    if name == "jaro_winkler":
        return _jaro_winkler_column(f)

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _over_pairs(lambda x, y: float(f(x, y)), a, b).astype("float64")

    return run


def programs(*names: str):
    """A function of two string columns that gives an array of the named PROGRAMS' values."""
    chosen = [PROGRAMS[n] for n in names]

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _over_pairs(lambda x, y: [float(f(x, y)) for f in chosen], a, b)

    return run


def _vector16(a: Column, b: Column) -> Column:
    longest, both = F.greatest(F.length(a), F.length(b)), F.length(a) + F.length(b)
    names = ("damerau", "jaro_winkler", "lcs", "ngram", "osa")
    found = programs(*names)(a, b)
    slow = {n: found[i] for i, n in enumerate(names)}
    edit = 1 - levenshtein_column(a, b) / longest
    common = (both - slow["lcs"]) / 2  # length of the common subsequence
    values = (
        cosine_column(a, b, 1), 1 - slow["damerau"] / longest, jaccard_column(a, b, 2), overlap_column(a, b, 3), slow["jaro_winkler"], edit, 1 - slow["lcs"] / both, common / longest,
        1 - slow["ngram"], edit, 1 - slow["osa"] / longest, overlap_column(a, b, 2), 1 - qgram_column(a, b, 2) / longest, dice_column(a, b, 2), edit, overlap_column(a, b, 1),
    )
    blank = (a == "") | (b == "")
    return F.array(*[F.when(blank, 0.0).otherwise(v.cast("double")) for v in values])


def _vector15(a: Column, b: Column) -> Column:
    names = ("damerau", "jaro_winkler", "lcs", "ngram", "osa_compat")
    found = programs(*names)(a, b)
    slow = {n: found[i] for i, n in enumerate(names)}
    edits, longest = levenshtein_column(a, b), F.greatest(F.length(a), F.length(b), F.lit(1))
    distance = F.greatest(F.length(a), F.length(b))
    metric_lcs_ = F.when(distance == 0, 0.0).otherwise(1 - (F.length(a) + F.length(b) - slow["lcs"]) / 2 / distance)
    values = (
        cosine_column(a, b, 1), -slow["damerau"], jaccard_column(a, b, 1) - 1, slow["jaro_winkler"], slow["jaro_winkler"], -edits, -slow["lcs"], -metric_lcs_, -slow["ngram"],
        1 - edits / longest, -slow["osa_compat"], overlap_column(a, b, 3) - 1, -qgram_column(a, b, 1), dice_column(a, b, 2), -edits,
    )
    return F.array(*[v.cast("double") for v in values])


def _vector2(a: Column, b: Column) -> Column:
    blank = (a == "") | (b == "")
    values = (-levenshtein_column(a, b), -programs("lcs")(a, b)[0])
    return F.array(*[F.when(blank, 0.0).otherwise(v.cast("double")) for v in values])


def vector(width: int = 16):
    """A function of two string columns that gives an array of measures, in a fixed order.

    16: similarities in the order of NAMES16, zeros if either string is empty.  15: for scaling and clustering
    without labels, similarities as they are and distances negated.  2: edits and common subsequence, negated.
    Null on either side gives null.  Sets and edits are built-in functions; the rest comes from one call.
    """
    make = {16: _vector16, 15: _vector15, 2: _vector2}[width]
    return lambda a, b: F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(make(a, b))


def token_vector():
    """A function of two columns of token arrays that gives vector4() of each pair."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = functools.lru_cache(100_000)(token_similarities)
        return pd.Series([None if x is None or y is None else [v for pair in zip(x, y, strict=False) for v in known(*pair)] for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def similarity_predicate(name: str, a: Column, b: Column, threshold: float) -> Column:
    """similar('name', a, b, threshold) by the names that rules use."""
    by_name = {
        "levenshtein": lambda: 1 - normalized_levenshtein_column(a, b), "cosine": lambda: cosine_column(a, b, 1), "jaccard": lambda: jaccard_column(a, b, 2),
        "jaro-winkler": lambda: metric("jaro_winkler")(a, b), "jaro_winkler": lambda: metric("jaro_winkler")(a, b),
    }
    return F.coalesce(by_name[name]() >= threshold, F.lit(False))

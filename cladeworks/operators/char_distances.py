"""Distances between taxa from aligned characters, as expressions over pairwise state counts ``t1, t2, ca, cb, w``.

Undefined values are null; :func:`repair` replaces them as a last step, from the largest defined distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "acgt"
PURINES = ("a", "g")


def _w(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("w")).otherwise(0.0))


def repair(d: DataFrame) -> DataFrame:
    """Undefined distances become 1 if the largest defined one is at most 1, else the next round number above 1.1 times it."""
    top = d.agg(F.coalesce(F.max("d"), F.lit(0.0))).scalar()
    m = F.lit(1.1) * F.col("top")
    unit = F.pow(F.lit(10.0), F.ceil(F.log10(m)) - 1)
    large = F.when(F.col("top") <= 1, 1.0).otherwise(F.ceil(m / unit) * unit)
    return d.withColumn("top", top).select("t1", "t2", F.coalesce("d", large).alias("d"))


def binary_counts(pairs: DataFrame) -> DataFrame:
    """``t1, t2, a, b, c``: sites with both, only the first, only the second taxon at state 1."""
    one, two = F.col("ca") == "1", F.col("cb") == "1"
    return pairs.groupBy("t1", "t2").agg(_w(one & two).alias("a"), _w(one & ~two).alias("b"), _w(~one & two).alias("c"))


def dice(n: DataFrame) -> DataFrame:
    below = 2 * F.col("a") + F.col("b") + F.col("c")
    return n.select("t1", "t2", F.when(below > 0, 1 - 2 * F.col("a") / below).alias("d"))


def jaccard(n: DataFrame, compat: bool = False) -> DataFrame:
    """1 - a/(a+b+c); ``compat``: the doubled form that equals Dice."""
    if compat:
        return dice(n)
    below = F.col("a") + F.col("b") + F.col("c")
    return n.select("t1", "t2", F.when(below > 0, 1 - F.col("a") / below).alias("d"))


def gene_sharing(n: DataFrame) -> DataFrame:
    below = F.least(F.col("a") + F.col("b"), F.col("a") + F.col("c"))
    return n.select("t1", "t2", F.when(below > 0, 1 - F.col("a") / below).alias("d"))


def gene_content(n: DataFrame) -> DataFrame:
    """Maximum-likelihood gene content distance; sizes relative to the mean genome size."""
    sizes = n.select("t1", (F.col("a") + F.col("b")).alias("s")).unionByName(n.select(F.col("t2").alias("t1"), (F.col("a") + F.col("c")).alias("s"))).groupBy("t1").agg(F.first("s").alias("s"))
    mean = sizes.agg(F.avg("s")).scalar()
    x = n.withColumn("m", mean)
    ai, aj, aij = (F.col("a") + F.col("b")) / F.col("m"), (F.col("a") + F.col("c")) / F.col("m"), F.col("a") / F.col("m")
    beta = 1 + aij - ai - aj
    arg = 0.5 * (beta + F.sqrt(beta * beta + 4 * aij * aij))
    return x.select("t1", "t2", F.when(arg < 1e-7, 1.0).otherwise(-F.log(arg)).alias("d"))


def _restriction(n: DataFrame) -> Column:
    return 2 * F.col("a") / (2 * F.col("a") + F.col("b") + F.col("c"))


def upholt(n: DataFrame, site_length: float = 1.0) -> DataFrame:
    return n.select("t1", "t2", F.when(F.col("a") > 0, -F.log(_restriction(n)) / site_length).alias("d"))


def nei_li(n: DataFrame, site_length: float = 1.0) -> DataFrame:
    x = (4 * F.pow(_restriction(n), F.lit(1 / (2 * site_length))) - 1) / 3
    return n.select("t1", "t2", F.when((F.col("a") > 0) & (x > 0), -1.5 * F.log(x)).alias("d"))


#: Sets of bases behind each nucleotide code (fixed values of the IUPAC alphabet).
CODES = {
    "a": "a", "c": "c", "g": "g", "t": "t", "u": "t", "r": "ag", "y": "ct", "s": "cg", "w": "at", "k": "gt", "m": "ac",
    "b": "cgt", "d": "agt", "h": "act", "v": "acg", "n": "acgt",
}


def _mask(c: Column) -> Column:
    pairs = [x for k, v in CODES.items() for x in (F.lit(k), F.lit(sum(1 << BASES.index(b) for b in v)))]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(0))


UNOBSERVED = {"nucleotide": ("?", "n"), "protein": ("?", "x"), "standard": ("?",)}


def hamming(pairs: DataFrame, normalize: bool = False, match_ambiguity: bool = True, match_gaps: bool = False, gap: str = "-", unobserved: tuple[str, ...] | None = None, data_type: str = "nucleotide") -> DataFrame:
    """Weighted mismatches over sites where both are observed; ``normalize`` divides by the sites compared.

    Unobserved are by default the missing character and the code of the whole alphabet (``n`` of nucleotides, ``x`` of
    proteins). Ambiguity codes are matched for nucleotides only.
    """
    a, b = F.lower("ca"), F.lower("cb")
    hidden = UNOBSERVED[data_type] if unobserved is None else unobserved
    seen = ~a.isin(gap, *hidden) & ~b.isin(gap, *hidden)
    same = (a == b) | ((_mask(a).bitwiseAND(_mask(b)) != 0) if match_ambiguity and data_type == "nucleotide" else F.lit(False))
    gaps = (a == gap) & (b == gap) if match_gaps else F.lit(False)
    n = pairs.groupBy("t1", "t2").agg(_w(seen | gaps).alias("n"), _w(seen & ~same).alias("x"))
    d = F.col("x") / F.col("n") if normalize else F.col("x")
    return n.select("t1", "t2", F.when(F.col("n") > 0, d).alias("d"))


def p_distance(pairs: DataFrame, **options) -> DataFrame:
    return hamming(pairs, normalize=True, **options)


def expanded(pairs: DataFrame, states: str = BASES, ignore_ambiguity: bool = False, keep_gaps: bool = False) -> DataFrame:
    """State pairs ``t1, t2, ca, cb, w`` over plain states, lower case. Gaps and unknown characters go, or with ``keep_gaps`` are ``-``.

    For nucleotides a code stands for each of its bases: two equal codes are spread over equal bases, two different ones
    over all combinations. ``ignore_ambiguity`` drops them instead.
    """
    low = pairs.select("t1", "t2", F.lower("ca").alias("ca"), F.lower("cb").alias("cb"), "w")
    if states != BASES:
        if keep_gaps:
            known = lambda c: F.when(F.col(c).isin(*states), F.col(c)).otherwise("-").alias(c)
            return low.select("t1", "t2", known("ca"), known("cb"), "w")
        return low.filter(F.col("ca").isin(*states) & F.col("cb").isin(*states))
    codes = {k: v for k, v in CODES.items() if len(v) == 1 or not ignore_ambiguity}
    sets = F.create_map(*(x for k, v in codes.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    x = low.select("t1", "t2", sets[F.col("ca")].alias("a"), sets[F.col("cb")].alias("b"), "w")
    if keep_gaps:
        x = x.select("t1", "t2", *(F.coalesce(c, F.array(F.lit("-"))).alias(c) for c in "ab"), "w")
    x = x.filter("a is not null and b is not null")
    cell = lambda p, q, n: F.struct(p.alias("ca"), q.alias("cb"), (F.col("w") / n).alias("w"))
    same = F.transform("a", lambda p: cell(p, p, F.size("a")))
    all_ = F.flatten(F.transform("a", lambda p: F.transform("b", lambda q: cell(p, q, F.size("a") * F.size("b")))))
    return x.select("t1", "t2", F.explode(F.when(F.col("a") == F.col("b"), same).otherwise(all_)).alias("c")).select("t1", "t2", "c.*")


def _shares(pairs: DataFrame) -> DataFrame:
    """Shares of transitions (ag, ct), transversions and bases, codes expanded."""
    plain = expanded(pairs)
    ag = (F.col("ca") != F.col("cb")) & F.col("ca").isin(*PURINES) & F.col("cb").isin(*PURINES)
    ct = (F.col("ca") != F.col("cb")) & ~F.col("ca").isin(*PURINES) & ~F.col("cb").isin(*PURINES)
    tv = F.col("ca").isin(*PURINES) != F.col("cb").isin(*PURINES)
    freq = [((_w(F.col("ca") == x) + _w(F.col("cb") == x)) / (2 * F.sum("w"))).alias(f"pi_{x}") for x in BASES]
    return plain.groupBy("t1", "t2").agg((_w(ag) / F.sum("w")).alias("ag"), (_w(ct) / F.sum("w")).alias("ct"), (_w(tv) / F.sum("w")).alias("q"), *freq)


def minv(x: Column, pinv: float = 0.0, gamma: float = 0.0) -> Column:
    """Inverse of the moment generating function of the site rates; null where undefined."""
    y = (x - pinv) / (1 - pinv)
    value = gamma * (1 - F.pow(y, F.lit(-1.0 / gamma))) if gamma > 0 else F.log(y)
    return F.when((x > 0) & (x - pinv > 0), value)


def felsenstein81(pairs: DataFrame, frequencies: tuple[float, ...] = (0.25,) * 4, pinv: float = 0.0) -> DataFrame:
    b = 1 - sum(p * p for p in frequencies)
    x = 1 - (F.col("ag") + F.col("ct") + F.col("q")) / b
    return _shares(pairs).select("t1", "t2", (-b * minv(x, pinv)).alias("d"))


def jukes_cantor(pairs: DataFrame, pinv: float = 0.0) -> DataFrame:
    return felsenstein81(pairs, pinv=pinv)


def kimura2(pairs: DataFrame, gamma: float = 0.0, pinv: float = 0.0) -> DataFrame:
    p, q = F.col("ag") + F.col("ct"), F.col("q")
    d = -0.5 * minv(1 - 2 * p - q, pinv, gamma) - 0.25 * minv(1 - 2 * q, pinv, gamma)
    return _shares(pairs).select("t1", "t2", d.alias("d"))


def felsenstein84(pairs: DataFrame, frequencies: tuple[float, ...] = (0.25,) * 4) -> DataFrame:
    pa, pc, pg, pt = frequencies
    r, y = pa + pg, pc + pt
    a, b, c = pc * pt / y + pa * pg / r, pc * pt + pa * pg, r * y
    p, q = F.col("ag") + F.col("ct"), F.col("q")
    d = -2 * a * minv(1 - p / (2 * a) - (a - b) * q / (2 * a * c)) + 2 * (a - b - c) * minv(1 - q / (2 * c))
    return _shares(pairs).select("t1", "t2", d.alias("d"))


def tamura_nei93(pairs: DataFrame) -> DataFrame:
    pa, pc, pg, pt = (F.col(f"pi_{x}") for x in BASES)
    r, y = pa + pg, pc + pt
    w1 = 1 - r * F.col("ag") / (2 * pa * pg) - F.col("q") / (2 * r)
    w2 = 1 - y * F.col("ct") / (2 * pc * pt) - F.col("q") / (2 * y)
    w3 = 1 - F.col("q") / (2 * r * y)
    k1, k2 = 2 * pa * pg / r, 2 * pc * pt / y
    k3 = 2 * (r * y - pa * pg * y / r - pc * pt * r / y)
    whole = (pa > 0) & (pc > 0) & (pg > 0) & (pt > 0)
    d = F.when(whole, F.when((w1 > 0) & (w2 > 0) & (w3 > 0), -k1 * F.log(w1) - k2 * F.log(w2) - k3 * F.log(w3)))
    return _shares(pairs).select("t1", "t2", d.alias("d"))


def log_det(pairs: DataFrame, states: str = BASES, pinv: float = 0.0, fudge: bool = False, fill_zeros: bool = False) -> DataFrame:
    """Log-determinant distance over the given states; the determinant is taken per pair in one vectorised pass.

    ``fudge`` scales each count by 1 + (gaps beside the row's state) / (the state) + the same of the column, and then with
    ``fill_zeros`` raises counts below a half to it where both states occur.
    """
    import numpy as np
    import pandas as pd

    r = len(states)
    a, b = F.col("ca"), F.col("cb")
    cells = [_w((a == x) & (b == y)) for x in states for y in states]
    gaps = [_w((a == x) & (b == "-")) for x in states] + [_w((a == "-") & (b == x)) for x in states]
    f = expanded(pairs, states, keep_gaps=True).groupBy("t1", "t2").agg(F.array(*cells).alias("f"), F.array(*gaps).alias("g"))

    def run(batches):
        for p in batches:
            if not len(p):
                continue
            m = np.stack(p.f.to_numpy()).reshape(-1, r, r).astype(float)
            if fudge:
                g = np.stack(p.g.to_numpy()).astype(float)
                x, y = m.sum(2), m.sum(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    row, col = np.where(x > 0, g[:, :r] / x, 0), np.where(y > 0, g[:, r:] / y, 0)
                m = m * (1 + row[:, :, None] + col[:, None, :])
                if fill_zeros:
                    m = np.where((x > 0)[:, :, None] & (y > 0)[:, None, :] & (m < 0.5), 0.5, m)
            total = m.sum((1, 2))
            with np.errstate(divide="ignore", invalid="ignore"):
                m = np.where(total[:, None, None] > 0, m / total[:, None, None], 0)
                x, y = m.sum(2), m.sum(1)
                pi = (x + y) / 2
                if 0 < pinv < 1:
                    m = m - pinv * pi[:, :, None] * np.eye(r)
                ev = np.linalg.eigvals(m).real
                ok = (ev > 0).all(1) & (total > 0)
                logs = np.where((x > 0) & (y > 0), np.log(x) + np.log(y), 0).sum(1) / 2
                d = -(1 - (pi**2).sum(1)) / (r - 1) * (np.log(ev).sum(1) - logs)
            yield pd.DataFrame({"t1": p.t1, "t2": p.t2, "d": np.where(ok, d, np.nan)})

    kind = dict(f.dtypes)["t1"]
    out = f.mapInPandas(run, f"t1 {kind}, t2 {kind}, d double")
    return out.select("t1", "t2", F.when(~F.isnan("d"), F.col("d")).alias("d"))


def base_frequency(chars: DataFrame, states: str = BASES, skip_last_site: bool = False) -> DataFrame:
    """Sum of absolute differences of the taxa's state shares. ``skip_last_site`` leaves out the site that sorts last."""
    low = chars.select("taxon", "site", F.lower("ch").alias("ch")).filter(F.col("ch").isin(*states))
    if skip_last_site:
        low = low.join(chars.agg(F.max("site").alias("site")), "site", "left_anti")
    share = low.groupBy("taxon").agg(*((F.sum(F.when(F.col("ch") == s, 1.0).otherwise(0.0)) / F.count(F.lit(1))).alias(f"s{i}") for i, s in enumerate(states)))
    v = share.select("taxon", F.array(*(f"s{i}" for i in range(len(states)))).alias("v"))
    a, b = v.select(F.col("taxon").alias("t1"), F.col("v").alias("x")), v.select(F.col("taxon").alias("t2"), F.col("v").alias("y"))
    d = F.aggregate(F.zip_with("x", "y", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, z: s + z)
    return a.join(b, F.col("t1") < F.col("t2")).select("t1", "t2", d.alias("d"))


SIMILARITY = {
    "log": lambda s: -F.log(s), "log100": lambda s: -F.log(s / 100), "one_minus": lambda s: 1 - s, "one_minus100": lambda s: 1 - s / 100,
    "odds": lambda s: (1 - s) / s, "odds100": lambda s: (100 - s) / s, "sqrt": lambda s: F.sqrt(1 - s), "sqrt100": lambda s: F.sqrt(1 - s / 100),
    "acos": lambda s: F.acos(s), "acos100": lambda s: F.acos(s / 100),
}


def similarity_to_distance(sim: DataFrame, method: str, fallback: float = 1.0) -> DataFrame:
    """Distances from similarities ``t1, t2, s`` given in either or both directions (averaged); out of the domain: ``fallback``."""
    f = SIMILARITY[method]
    v = f(F.col("s"))
    scale = 100.0 if method.endswith("100") else 1.0
    ok = (F.col("s") >= 0) & (F.col("s") <= scale) & ((F.col("s") > 0) | F.lit("log" not in method and "odds" not in method))
    d = F.when(ok, v).otherwise(F.lit(fallback))
    return sim.select(F.least("t1", "t2").alias("t1"), F.greatest("t1", "t2").alias("t2"), d.alias("d")).filter("t1 < t2").groupBy("t1", "t2").agg(F.avg("d").alias("d"))


# ---------------------------------------------------------------- models fitted pair by pair


def _state_matrices(pairs: DataFrame, states: str) -> DataFrame:
    """``t1, t2, f ARRAY<DOUBLE>``: shares of the states' combinations, row by row."""
    low = expanded(pairs, states)
    at = lambda c: F.instr(F.lit(states), F.col(c)) - 1
    cells = low.select("t1", "t2", (at("ca") * len(states) + at("cb")).alias("k"), "w").groupBy("t1", "t2", "k").agg(F.sum("w").alias("w"))
    m = cells.groupBy("t1", "t2").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("m"), F.sum("w").alias("n"))
    f = F.transform(F.sequence(F.lit(0), F.lit(len(states) ** 2 - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0)) / F.col("n"))
    return m.select("t1", "t2", f.alias("f"))


def rate_matrix(exchange, frequencies):
    """Normalised reversible rate matrix: exchangeabilities (symmetric) times target frequencies, mean rate 1."""
    import numpy as np

    pi = np.asarray(frequencies, float) / np.sum(frequencies)
    q = np.asarray(exchange, float) * pi[None, :]
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(1))
    return q / -(pi * np.diag(q)).sum(), pi


def hky_exchange(frequencies, ts_tv_ratio: float = 2.0):
    """Exchangeabilities of bases a, c, g, t with the given expected ratio of transitions to transversions."""
    import numpy as np

    a, c, g, t = frequencies
    kappa = ts_tv_ratio * (a + g) * (c + t) / (a * g + c * t)
    x = np.ones((4, 4))
    x[0, 2] = x[2, 0] = x[1, 3] = x[3, 1] = kappa
    return x


def _per_pair(pairs: DataFrame, states: str, of) -> DataFrame:
    import numpy as np
    import pandas as pd

    def run(batches):
        for p in batches:
            r = len(states)
            d = [of(np.asarray(f, float).reshape(r, r)) for f in p.f]
            yield pd.DataFrame({"t1": p.t1, "t2": p.t2, "d": np.array(d, float)})

    f = _state_matrices(pairs, states)
    kind = dict(f.dtypes)["t1"]
    out = f.mapInPandas(run, f"t1 {kind}, t2 {kind}, d double")
    return out.select("t1", "t2", F.when(~F.isnan("d"), F.col("d")).alias("d"))


def ml_distance(pairs: DataFrame, exchange, frequencies, states: str = BASES, longest: float = 2.0) -> DataFrame:
    """Maximum-likelihood distance under any reversible model (HKY85, GTR or a protein matrix given as ``exchange``).

    The likelihood of a pair's state counts is maximised over the branch length by golden section.
    """
    import numpy as np

    q, pi = rate_matrix(exchange, frequencies)
    s = np.sqrt(pi)
    val, vec = np.linalg.eigh((q * s[:, None] / s[None, :] + (q * s[:, None] / s[None, :]).T) / 2)
    left, right = vec / s[:, None], vec.T * s[None, :]

    def of(f):
        def loss(t):
            p = np.maximum(left @ (np.exp(val * t)[:, None] * right), 1e-300)
            return -(f * np.log(p)).sum()

        g, lo, hi = (5**0.5 - 1) / 2, 1e-8, longest
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        fa, fb = loss(a), loss(b)
        while hi - lo > 1e-7:
            if fa < fb:
                hi, b, fb = b, a, fa
                a = hi - g * (hi - lo)
                fa = loss(a)
            else:
                lo, a, fa = a, b, fb
                b = lo + g * (hi - lo)
                fb = loss(b)
        return (lo + hi) / 2

    return _per_pair(pairs, states, of)


def hky85(pairs: DataFrame, frequencies: tuple[float, ...] = (0.25,) * 4, ts_tv_ratio: float = 2.0) -> DataFrame:
    return ml_distance(pairs, hky_exchange(frequencies, ts_tv_ratio), frequencies)


def gtr(pairs: DataFrame, frequencies: tuple[float, ...] = (0.25,) * 4, pinv: float = 0.0) -> DataFrame:
    """General time-reversible distance: minus the trace of the frequencies times the logarithm of the symmetrised shares."""
    import numpy as np

    pi = np.asarray(frequencies, float)
    s = np.sqrt(pi)

    def of(f):
        val, vec = np.linalg.eigh((f + f.T) / 2 / np.outer(s, s))
        if (val <= pinv).any():
            return np.nan
        return float(-(pi[:, None] * vec**2 * np.log((val - pinv) / (1 - pinv))[None, :]).sum())

    return _per_pair(pairs, BASES, of)

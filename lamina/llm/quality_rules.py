"""Quality rules whose thresholds are chosen from labelled documents with a guarantee.

Each rule compares a share of the text (symbols, capitals, exclamation marks, repeated lines) with a
cutoff. Cutoffs come from labelled holdouts, one set of rules for each stratum (language), whose false
rejections are bounded together: with probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good
documents to all its rules.

A third of a stratum's labelled texts orders the candidates: from no rule on, each step tightens the
cutoff that gains most (bad documents caught, less ``price`` times the good ones lost). The other two thirds,
which have had no say in that order, test the steps one after the other: an exact binomial test of the whole
set of rules against ``alpha``. The first step that fails ends the walk, so a stratum's steps need no correction
among themselves (fixed sequence); for the number of strata, delta is divided by it. A stratum with too few
labels to pass any test has no rules.
"""

import math
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialize
from .tokens import short_batches

ALPHA, DELTA, PRICE = 0.05, 0.05, 10
#: Cutoffs that are tried, by rule, ascending; a text is rejected above its cutoff.
GRID = {
    "symbols": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7],
    "capitals": [0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "exclamations": [0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8, 1.2],
    "repeated_lines": [0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
}
#: One labelled text of so many orders the candidates, the others test them.
ORDERING = 3
#: Strata with cutoffs, or rejected documents (about 40 bytes each), that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_letters long, n_capitals long, n_exclamations long, n_lines long"
SPACES, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
SPAN = 5


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts named in STATS of a whole text; a null text is empty. Words are runs without ASCII white space."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    of = lambda some: len(raw) - len(raw.translate(None, some))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spans = [*zip(*(words[k:] for k in range(SPAN)), strict=False)]
    repeated = 0
    if len(set(spans)) < len(spans):
        times, covered = Counter(spans), 0
        for k, span in enumerate(spans):
            if times[span] > 1:
                repeated += k + SPAN - max(covered, k)
                covered = k + SPAN
    return len(words), len(text or "") - of(SPACES), of(SYMBOLS), len(lines) - len(set(lines)), repeated, of(LETTERS), of(CAPITALS), raw.count(b"!"), len(lines)


def _stats(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(t) for t in texts], columns=[x.split()[0] for x in STATS.split(", ")])

    return F.pandas_udf(run, STATS)(text)


def _shares(s: str) -> dict[str, Column]:
    of = lambda a, b: F.coalesce(F.try_divide(F.col(f"{s}.{a}"), F.col(f"{s}.{b}")), F.lit(0.0))
    return {"symbols": of("n_symbols", "n_words"), "capitals": of("n_capitals", "n_letters"), "exclamations": of("n_exclamations", "n_words"), "repeated_lines": of("n_dup_lines", "n_lines")}


def _base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < 10) | (100 * F.col(f"{s}.n_repeat_words") > 20 * F.col(f"{s}.n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact: the regularised incomplete beta function I_{1-p}(n - k, k + 1)."""
    if k >= n:
        return 1.0
    x, a, b = 1 - p, n - k, k + 1
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(p, b, a)
    return _beta_fraction(x, a, b)


def _beta_fraction(x: float, a: float, b: float) -> float:
    """I_x(a, b) by its continued fraction, which converges fast for x below (a + 1) / (a + b + 2)."""
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    d = 1 / (1 - (a + b) * x / (a + 1))
    c, value = 1.0, d
    for m in range(1, 100_000):
        for term in (m * (b - m) / (a + 2 * m - 1), -(a + m) * (a + b + m) / (a + 2 * m + 1)):
            term *= x / (a + 2 * m)
            d = 1 / (1 + term * d)
            c = 1 + term / c
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return min(1.0, front * value)


#: Labelled texts of a stratum: how many there are with each (orders, label, bins), bins in the order of the grid's rules.
Counts = Counter[tuple[bool, int, tuple[int, ...]]]


def _rejected_by(cuts: tuple[int, ...], counts: Counts, orders: bool) -> tuple[int, int]:
    """(good, bad) texts of a part with a bin above its cut. Bin k: the text is above k cutoffs of a rule's grid."""
    lost = [0, 0]
    for (part, label, bins), n in counts.items():
        if part == orders and any(b > c for b, c in zip(bins, cuts, strict=True)):
            lost[label] += n
    return lost[1], lost[0]


def walk(counts: Counts, grid: dict[str, list[float]], price: float) -> list[tuple[int, ...]]:
    """The steps from no rule on, as an index of the grid for each rule (its length: not used), from the ordering part alone.

    Of equal gains the laxer cutoff is taken, then the rule named first.
    """
    sizes = [len(c) for c in grid.values()]
    now, value, steps = tuple(sizes), 0.0, []
    while True:
        best = None
        for r in range(len(sizes)):
            for k in range(now[r] - 1, -1, -1):
                cuts = (*now[:r], k, *now[r + 1 :])
                good, bad = _rejected_by(cuts, counts, True)
                if bad - price * good > (best[0] if best else value):
                    best = bad - price * good, cuts
        if best is None:
            return steps
        value, now = best
        steps.append(now)


def allowed_cutoffs(counts: dict[str, Counts], *, strata: int | None = None, alpha: float = ALPHA, delta: float = DELTA, price: float = PRICE, grid: dict[str, list[float]] = GRID) -> dict[str, dict[str, float]]:
    """{stratum: {rule: cutoff}}: the last step of each stratum's walk before a test fails.

    ``strata``: how many share delta, those without counts here too.
    """
    level = delta / max(1, strata or len(counts))
    chosen: dict[str, dict[str, float]] = {}
    for stratum, seen in counts.items():
        n = sum(v for (orders, label, _), v in seen.items() if label == 1 and not orders)
        for cuts in walk(seen, grid, price):
            if not n or binomial_cdf(_rejected_by(cuts, seen, False)[0], n, alpha) > level:
                break
            chosen[stratum] = {rule: cs[k] for (rule, cs), k in zip(grid.items(), cuts, strict=True) if k < len(cs)}
    return chosen


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, h, s) of ``docs`` (doc_id, text, lang), counted once and written: s holds the counts of STATS, h the
    xxhash64 of the text; a null lang is a stratum of its own, named ''."""
    short_batches(docs.sparkSession)
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum.alias("stratum"), F.xxhash64("text").alias("h"), _stats(F.col("text")).alias("s")), "stats")


def calibrate(stats: DataFrame, labels: DataFrame, **options) -> dict[str, dict[str, float]]:
    """Cutoffs from all labelled documents of ``stats`` (as ``counted`` returns) that pass the base rules.

    Each text of a stratum counts once, so that copies don't pass for evidence, and as bad if a label is 0; null labels and
    ids count nowhere. Only counts per stratum, label and bins reach the driver, and only of strata with labels
    enough for some test.
    """
    grid, alpha, delta = options.get("grid", GRID), options.get("alpha", ALPHA), options.get("delta", DELTA)
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    shares = _shares("s")
    bins = F.array(*(sum((shares[r] > c).cast("int") for c in cs) for r, cs in grid.items()))
    rows = stats.where(~_base_failed("s")).join(known, "doc_id").select("stratum", "h", "quality", bins.alias("bins"))
    texts = rows.groupBy("stratum", "h").agg(F.min("quality").alias("quality"), F.min("bins").alias("bins"))
    sums = materialize(texts.groupBy("stratum", (F.pmod("h", F.lit(ORDERING)) == 0).alias("orders"), "quality", "bins").count(), "bins")
    good = sums.where("quality = 1 and not orders").groupBy("stratum").agg(F.sum("count").alias("n"))
    strata = sums.select("stratum").distinct().count()
    least = math.ceil(math.log(delta / max(1, strata)) / math.log1p(-alpha))
    counts: dict[str, Counts] = defaultdict(Counter)
    for r in sums.join(good.where(F.col("n") >= least).select("stratum"), "stratum").collect():
        counts[r["stratum"]][r["orders"], r["quality"], tuple(r["bins"])] += r["count"]
    discard(sums)
    return allowed_cutoffs(dict(sorted(counts.items())), strata=strata, **options)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, stratum, h, s, base_failed, kept) for every row of ``docs`` (doc_id, text, lang).

    Null and empty texts have no words and fail the base rules; repeated rows are judged each; an empty
    table gives no rows, and empty labels leave the base rules alone to judge. Other columns are not read.
    """
    stats = counted(docs)
    cutoffs = calibrate(stats, labels, **options)
    rules = sorted({r for c in cutoffs.values() for r in c})
    table = docs.sparkSession.createDataFrame([(k, *(c.get(r) for r in rules)) for k, c in cutoffs.items()], "stratum string" + "".join(f", above_{r} double" for r in rules))
    joined = stats.join(F.broadcast(table) if len(cutoffs) <= BROADCAST_ROWS else table, "stratum", "left")
    shares, rejected = _shares("s"), F.lit(False)
    for r in rules:  # a stratum without a cutoff rejects nothing beyond the base rules
        rejected = rejected | F.coalesce(shares[r] > F.col(f"above_{r}"), F.lit(False))
    return joined.select(*stats.columns, _base_failed("s").alias("base_failed"), (~_base_failed("s") & ~rejected).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang), with all their columns, that ``judge`` keeps; columns of any name stay."""
    gone = materialize(judge(docs, labels, **options).where("not kept").select(F.col("doc_id").alias("d"), F.col("h").alias("dh"), F.col("stratum").alias("ds")).distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("h"), stratum.alias("s"))
    return row.join(gone, F.col("k").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh")) & (F.col("s") == F.col("ds")), "left_anti").select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges the whole documents table with cutoffs from all labels."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", "base_failed", "kept", F.col("stratum").alias("lang"))

"""Quality rules: base rules on words, and robust multivariate outliers by minimum covariance determinant.

DataFrame functions only. One pass over the texts counts; everything after works on a light table of counts. Counts become
a vector of transformed statistics (VECTOR). For each (lang, source), each lang and for all rows, location and scatter are
estimated by minimum covariance determinant: several deterministic starts (medians and quartiles with no correlation, with
that of hyperbolic tangents, with that of spatial signs), concentration steps on each (keep the share H of vectors with the
least Mahalanobis distance, estimate anew, note the determinant), after START_STEPS of them the start with the least
determinant goes on until its determinant stands still. One reweighting follows: estimates from all vectors within the
chi-squared quantile WITHIN. Scatters are corrected for the share left out; a variance that is below a statistic's
resolution (FLOORS: it may be constant in a group) is raised to it.

Equal vectors of a group count once in its estimates, and H is one half, so that neither copies nor near copies of one page
that hold a third of a group become its normal case. A document is judged by its (lang, source) if that has LEAST vectors,
else by its lang, else by all rows (column level); it is rejected where its squared distance exceeds the chi-squared
quantile CUT: of rows that are normal about their group's location, one in 10,000 goes, and fewer where variances were raised.

Null texts have no words; texts without words fail the base rules. Null lang and source are groups of their own. Repeated
rows are judged each. Ties at the share's edge are all kept. Empty tables give no rows. Hot groups: all estimates are sums and
sketches that tasks combine before the exchange; estimates reach the rows by a broadcast where they are FEW at most (they
are counted first), else by a join on group and salt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm._common import WORD, materialise, shared_dir

#: Share of vectors in a concentration step, the reweighting's quantile, least distinct vectors of a group that judges its own, and the quantile beyond which rows go.
H, WITHIN, LEAST, CUT = 0.5, 0.975, 200, 1 - 1e-4
#: Steps on every start; most steps on the best; change of the log determinant that counts as standing still.
START_STEPS, STEPS, STILL = 2, 12, 1e-2
#: Estimates that are broadcast at most; salts of the join beyond.
FEW, SALTS = 20_000, 16
MIN_WORDS, MOST_REPEATED = 10, 20
SYMBOLS = "[#*$%&|<>]"
VECTOR = ("log_words", "word_length", "symbol_share", "upper_share", "line_share")
#: Least standard deviation per statistic.
FLOORS = (0.5, 0.35, 0.06, 0.06, 0.08)


def chi2_cdf(x: float, p: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, half = p / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= half / n
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return (lo + hi) / 2


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, n: int = 5) -> Column:
    """Words of an array in windows of five words that are found twice or more in it, the first included."""

    pair = lambda a, b: F.xxhash64(a, b)

    def hashed(h: Column) -> Column:
        tail = lambda a, k: F.slice(a, k + 1, F.greatest(F.size(h), F.lit(1)))
        two = lambda a: F.zip_with(a, tail(a, 1), pair)
        five = lambda t: _let(F.zip_with(t, tail(t, 2), pair), lambda q: F.zip_with(q, tail(h, 4), pair))
        return F.slice(_let(two(h), five), F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0)))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(n), F.coalesce(b - a, F.lit(n))))
        return F.aggregate(steps, F.lit(0), lambda t, x: t + x)

    def positions(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))
        found = F.filter(s, lambda x, k: same(x, k + 1) | (F.when(k > 0, same(x, F.greatest(k - 1, F.lit(0)))).otherwise(F.lit(False))))
        return _let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def counted(g: Column) -> Column:
        places = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_let(places, positions))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(hashed(h), counted)).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """Counts of every text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines; with doc_id, lang, source."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    by_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    by_lines = lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"))
    rows = docs.select(
        F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        _let(words, by_words).alias("w"), _let(lines, by_lines).alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    return rows.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "n_upper", "l.n_lines")


def _vector(rows: DataFrame) -> DataFrame:
    """Adds base_failed and the transformed statistics."""
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return rows.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        "log_words": F.log1p("n_words"),
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.sqrt(F.col("n_symbols") / chars),
        "upper_share": F.sqrt(F.col("n_upper") / chars),
        "line_share": F.sqrt(F.col("n_lines") / words),
    })


def _levels(rows: DataFrame) -> DataFrame:
    """Each row under its (lang, source), its lang and all."""
    key = lambda level, *names: F.to_json(F.struct(F.lit(level).alias("level"), *names))
    return rows.withColumn("group", F.explode(F.array(key(2, "lang", "source"), key(1, "lang"), key(0))))


def _inverse_root(params: DataFrame) -> DataFrame:
    """Adds the rows of the inverse Cholesky factor (r_i_j) of each group's scatter (c_i_j), so that distances are sums of squares, and the log determinant."""
    p = range(len(VECTOR))
    for i in p:
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            params = params.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    for i in p:
        for j in range(i + 1):
            if i == j:
                params = params.withColumn(f"r_{i}_{j}", 1 / F.col(f"l_{i}_{i}"))
            else:
                total = F.lit(0.0)
                for k in range(j, i):
                    total = total + F.col(f"l_{i}_{k}") * F.col(f"r_{k}_{j}")
                params = params.withColumn(f"r_{i}_{j}", -total / F.col(f"l_{i}_{i}"))
    logdet = F.lit(0.0)
    for i in p:
        logdet = logdet + 2 * F.ln(f"l_{i}_{i}")
    return params.select("group", "rows", "start", *[f"m_{i}" for i in p], *[f"r_{i}_{j}" for i in p for j in range(i + 1)], logdet.alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's estimates."""
    total = F.lit(0.0)
    for i in range(len(VECTOR)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"r_{i}_{j}") * (F.col(VECTOR[j]) - F.col(f"m_{j}"))
        total = total + z * z
    return total


def _joined(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """Rows with the estimates of their group (each of its starts): broadcast, or by group and salt, so that no group is one task."""
    if few:
        return rows.join(F.broadcast(params), "group")
    salted = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*VECTOR), F.lit(SALTS)).cast("int")).join(salted, ["group", "salt"]).drop("salt")


def _pairs():
    return [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]


def _starts(levels: DataFrame, few: bool, folder: str) -> DataFrame:
    """The starts of every group: medians with scales from the quartiles, and three correlations."""
    p = range(len(VECTOR))
    quartiles = levels.groupBy("group").agg(F.count("*").alias("rows"), *[F.percentile_approx(c, [0.25, 0.5, 0.75]).alias(f"q_{i}") for i, c in enumerate(VECTOR)])
    centre = quartiles.select("group", "rows", *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in p], *[F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(FLOORS[i])).alias(f"s_{i}") for i in p])
    centre = materialise(centre, f"{folder}/centre")
    z = _joined(levels, centre, few).select("group", *[((F.col(c) - F.col(f"m_{i}")) / F.col(f"s_{i}")).alias(f"z_{i}") for i, c in enumerate(VECTOR)])
    norm = F.lit(0.0)
    for i in p:
        norm = norm + F.col(f"z_{i}") * F.col(f"z_{i}")
    z = z.withColumn("norm", F.greatest(F.sqrt(norm), F.lit(1e-9))).select("group", *[F.tanh(f"z_{i}").alias(f"t_{i}") for i in p], *[(F.col(f"z_{i}") / F.col("norm")).alias(f"u_{i}") for i in p])
    sums = z.groupBy("group").agg(*[F.avg(f"t_{i}").alias(f"t_{i}") for i in p], *[F.avg(F.col(f"t_{i}") * F.col(f"t_{j}")).alias(f"t_{i}_{j}") for i, j in _pairs()], *[F.avg(F.col(f"u_{i}") * F.col(f"u_{j}")).alias(f"u_{i}_{j}") for i, j in _pairs()])
    by_tanh = lambda i, j: F.col(f"t_{i}_{j}") - F.col(f"t_{i}") * F.col(f"t_{j}")
    by_sign = lambda i, j: F.col(f"u_{i}_{j}")
    both = materialise(centre.join(sums, "group"), f"{folder}/correlated")

    def start(k: int, moment) -> DataFrame:
        def entry(i: int, j: int) -> Column:
            if i == j:
                return F.col(f"s_{i}") * F.col(f"s_{i}")
            if moment is None:
                return F.lit(0.0)
            both_ = moment(i, i) * moment(j, j)
            return F.when(both_ > 1e-18, moment(i, j) / F.sqrt(both_)).otherwise(0.0) * F.col(f"s_{i}") * F.col(f"s_{j}")

        return both.select("group", "rows", F.lit(k).alias("start"), *[f"m_{i}" for i in p], *[entry(i, j).alias(f"c_{i}_{j}") for i, j in _pairs()])

    return _inverse_root(start(0, None).unionByName(start(1, by_tanh)).unionByName(start(2, by_sign)))


def _estimates(inner: DataFrame, grow: float) -> DataFrame:
    """Location and corrected scatter of the rows that stay, per group and start; sums about the last centre keep the products well scaled."""
    p = range(len(VECTOR))
    x = [F.col(c) - F.col(f"m_{i}") for i, c in enumerate(VECTOR)]
    sums = inner.groupBy("group", "start").agg(F.first("rows").alias("rows"), *[F.first(f"m_{i}").alias(f"o_{i}") for i in p], *[F.avg(x[i]).alias(f"a_{i}") for i in p], *[F.avg(x[i] * x[j]).alias(f"s_{i}_{j}") for i, j in _pairs()])
    new = {f"m_{i}": F.col(f"o_{i}") + F.col(f"a_{i}") for i in p}
    for i, j in _pairs():
        scatter = (F.col(f"s_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}")) * grow
        new[f"c_{i}_{j}"] = F.greatest(scatter, F.lit(FLOORS[i] ** 2)) if i == j else scatter
    return _inverse_root(sums.withColumns(new))


def estimate(vectors: DataFrame, folder: str, *, few: int = FEW) -> DataFrame:
    """Minimum-covariance-determinant location and inverse root scatter of every group, reweighted, with its number of distinct vectors (rows)."""
    # copies count once; the distinct vectors are read by every step
    levels = materialise(_levels(vectors).select("group", *VECTOR).distinct(), f"{folder}/levels")
    groups = levels.select("group").distinct().count()
    params = materialise(_starts(levels, groups <= few, folder), f"{folder}/step-0")
    correct = lambda q: q / chi2_cdf(chi2_quantile(q, len(VECTOR)), len(VECTOR) + 2)
    done = None
    for step in range(1, STEPS + 1):
        small = (3 if step <= START_STEPS else 1) * groups <= few
        edge = _joined(levels, params, small).groupBy("group", "start").agg(F.percentile_approx(_distance(), H, 1000).alias("edge"))
        before = params.select("group", "start", F.col("logdet").alias("before"))
        edged = params.join(F.broadcast(edge) if small else edge, ["group", "start"])
        new = _estimates(_joined(levels, edged, small).filter(_distance() <= F.col("edge")), correct(H)).join(F.broadcast(before) if small else before, ["group", "start"])
        new = materialise(new, f"{folder}/step-{step}")
        if step < START_STEPS:
            params = new.drop("before")
        elif step == START_STEPS:
            names = [c for c in params.columns if c not in ("group", "logdet")]
            best = new.groupBy("group").agg(F.min(F.struct("logdet", *names)).alias("e")).select("group", "e.*").select(*params.columns)
            params = materialise(best, f"{folder}/best")
        else:  # groups that stand still leave the loop
            still = (F.abs(F.col("logdet") - F.col("before")) < STILL) | F.lit(step == STEPS)
            ended = new.filter(still).drop("before")
            done = ended if done is None else done.unionByName(ended)
            params = new.filter(~still).drop("before")
            if params.isEmpty():
                break
    params = materialise(done, f"{folder}/still")
    within = _joined(levels, params, groups <= few).filter(_distance() <= chi2_quantile(WITHIN, len(VECTOR)))
    return materialise(_estimates(within, correct(WITHIN)), f"{folder}/reweighted")


def quality_rules(docs: DataFrame, *, least: int = LEAST, cut: float = CUT, few: int = FEW) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, level.

    docs needs doc_id, text, lang and source. distance is squared; it and level (2: judged by lang and source, 1: by lang,
    0: by all rows) are null for rows that fail the base rules.
    """
    folder = shared_dir(docs.sparkSession, "quality-rules")
    rows = _vector(materialise(counts(docs), f"{folder}/counts"))
    vectors = rows.filter(~F.col("base_failed"))
    params = estimate(vectors, folder, few=few)
    # each group is judged by the finest level that has enough rows
    groups = vectors.select("lang", "source").distinct()
    fit = params.filter((F.col("rows") >= least) | (F.get_json_object("group", "$.level") == "0"))
    judge = _levels(groups).join(fit, "group").withColumn("level", F.get_json_object("group", "$.level").cast("int"))
    names = [c for c in params.columns if c not in ("group", "rows", "start", "logdet")]
    best = judge.groupBy("lang", "source").agg(F.max_by(F.struct("level", *names), "level").alias("e")).select(F.col("lang").alias("e_lang"), F.col("source").alias("e_source"), "e.*")
    best = materialise(best, f"{folder}/judges")
    if best.count() <= few:
        best = F.broadcast(best)
    joined = rows.join(best, F.col("lang").eqNullSafe(F.col("e_lang")) & F.col("source").eqNullSafe(F.col("e_source")), "left")
    distance = F.when(~F.col("base_failed"), _distance())
    kept = F.coalesce(distance <= chi2_quantile(cut, len(VECTOR)), F.lit(False))
    level = F.when(~F.col("base_failed"), F.col("level"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), distance.alias("distance"), level.alias("level"))

"""Operator 8, quality rules with robust multivariate outliers; DataFrame expressions only.

Every text gives a statistic vector. Hard rules reject first. What they leave is fitted per (language, source) by the
minimum covariance determinant, with deterministic starts: median and MAD, the spatial signs, and a hyperbolic tangent of
the scaled values. From each start, concentration steps go on with the half of the rows that has the smallest Mahalanobis
distance until the determinant falls no more; the start with the smallest determinant wins, a reweighting step follows,
and rows beyond the cutoff are outliers. All fits are mergeable aggregates over a small checkpointed table, so a source
with a third of all rows only adds partial sums. Values lie on a grid of 1 / UNIT and sums are exact integers; medians
come from counts per grid value and distances are halved at a bin edge, so a verdict does not depend on how rows are
dealt. FLOORS are added to the diagonal and keep the estimate regular where a statistic is constant in most rows.

Defined results: null, empty or blank text has no words and fails the base rule; null language or source is a group of
its own; a group too small for a covariance is judged by the floors around its centre; ties at the half-sample threshold
are all in; repeated rows count as often as they occur; an empty table gives no rows. Extra columns whose names clash
with statistics are left alone, as statistics are made in a separate projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphloom.llm.common import fresh, pinned, spread, table

BLANKS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
FEATURES = ("f_len", "f_sym", "f_dup", "f_rep")
#: Smallest standard deviation of each feature: ln mean word length, root symbol share, duplicate-line share, repeated-word share.
FLOORS = (0.06, 0.04, 0.08, 0.08)
#: Fixed values for four dimensions: chi-square quantiles 0.5 and 0.975, and the consistency factor 0.5 / P(chi2_6 <= 3.357).
HALF_CHI2, REWEIGHT_CHI2, HALF_FACTOR = 3.357, 11.143, 2.11
#: Chi-square quantile 0.999999 for four dimensions.
CUTOFF = 33.38
#: Parameter tables of at most so many groups are broadcast (about 150 bytes each); larger ones are joined by shuffle.
BROADCAST_GROUPS = 20_000
#: Rejected rows are broadcast up to so many (24 bytes each), else joined by shuffle.
BROADCAST_REJECTED = 1_000_000
KEYS = ("g_lang", "g_source")
#: Grid of the features, and of the values that make up the two derived starts.
UNIT, FINE = 10_000, 1_000_000
#: Bins of distances per unit of their logarithm, and the fall of a determinant that is worth another step.
BINS, FALL = 50, 1e-2
STARTS = ("median", "sign", "tanh")
#: Bins of up to so many groups and starts (some 1400 bins of 300 bytes each) are summed in one task; and vectors are read with so many rows a task at least.
ONE_TASK, TASK_ROWS = 100, 20_000


def statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of docs: id, h (a hash of text and group), group and base statistics."""
    base = docs.select(F.col(id_col).alias("id"), row_hash(text, lang, source).alias("h0"), F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    head = ["id", "h0", *KEYS]
    split = base.select(
        *head,
        F.split(F.btrim("t", F.lit(BLANKS)), SPACE).alias("w0"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
    )
    words = split.select(
        *head, F.char_length(F.concat_ws("", "w0")).cast("long").alias("word_chars"), "n_symbols", "lines",
        F.when(F.get("w0", F.lit(0)) == "", F.array().cast("array<string>")).otherwise(F.col("w0")).alias("w"),
    )
    hashed = words.select(
        *head, "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
        .otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    stat = ("word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines")
    ordered = hashed.select(
        *head, *stat,
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"),
    )
    # Sorted by window, the copies of a window are neighbours.
    placed = ordered.select(
        *head, *stat, F.col("s").isNull().alias("none"),
        F.when(F.col("s").isNotNull(), F.expr("transform(filter(s, (e, k) -> get(s, k - 1).x <=> e.x or get(s, k + 1).x <=> e.x), e -> e.i)")).alias("at"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.array(p, p + 1, p + 2))))).cast("long")
    return placed.select(
        "id", F.col("h0").alias("h"), *KEYS, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.col("none"), F.lit(0).cast("long")).otherwise(covered).alias("n_repeat_words")
    )


def row_hash(text: str, lang: str, source: str) -> Column:
    """What a verdict depends on; nulls are told from each other's places."""
    return F.xxhash64(*(x for c in (text, lang, source) for x in (F.col(c).isNull(), F.col(c))))


def with_features(stats: DataFrame) -> DataFrame:
    """Adds base_failed and the transformed statistic vector (null where there is no word)."""
    n = F.nullif(F.col("n_words"), F.lit(0).cast("long")).cast("double")
    return stats.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.ln(F.col("word_chars") / n).alias("f_len"),
        F.sqrt(F.col("n_symbols") / F.nullif(F.col("word_chars"), F.lit(0).cast("long"))).alias("f_sym"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("f_dup"),
        (F.col("n_repeat_words") / n).alias("f_rep"),
    )


P = range(len(FEATURES))
LOWER_LEFT = [(i, j) for i in P for j in range(i + 1)]


def _distance() -> Column:
    """Squared Mahalanobis distance of q_i by forward substitution with the Cholesky factor in columns l_ij and centre m_i."""
    y: list[str] = []
    for i in P:
        y.append(f"((q{i} / {float(UNIT)}D - m{i}{''.join(f' - l{i}{j} * {y[j]}' for j in range(i))}) / l{i}{i})")
    return F.expr(" + ".join(f"{v} * {v}" for v in y))


def _cholesky(params: DataFrame, keys: tuple[str, ...], small: bool) -> DataFrame:
    """(keys, m_i, l_ij, det) from c_ij, floors on the diagonal; later entries use earlier ones by name, behind a shuffle of the table, which keeps expressions small; a table of few groups is one partition."""
    made = []
    for i, j in LOWER_LEFT:
        v = f"coalesce(c{i}{j}, 0D)" + (f" + {FLOORS[i] ** 2!r}D" if i == j else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        made.append(f"sqrt(greatest({v}, {(FLOORS[i] / 10) ** 2!r}D)) AS l{i}{j}" if i == j else f"({v}) / l{j}{j} AS l{i}{j}")
    return (params.repartition(1) if small else spread(params)).selectExpr(*keys, *(f"m{i}" for i in P), *made, " * ".join(f"l{i}{i} * l{i}{i}" for i in P) + " AS det")


def _keyed(rows: DataFrame, params: DataFrame, small: bool, how: str = "left", keys: tuple[str, ...] = KEYS) -> DataFrame:
    renamed = params.withColumnsRenamed({k: f"p_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    return rows.join(F.broadcast(renamed) if small else spread(renamed), on, how).drop(*(f"p_{k}" for k in keys))


def _middle(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(keys, mid): the lower median of a value on a grid, from counts per value."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*keys).orderBy(value)
    whole = counts.withColumns({"up_to": F.sum("n").over(run), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return whole.filter(2 * F.col("up_to") >= F.col("all")).groupBy(*keys).agg(F.min(value).alias("mid"))


def _medians(rows: DataFrame) -> DataFrame:
    """(KEYS, a0..a3) of rows(KEYS, q0..q3)."""
    long = rows.select(*KEYS, F.posexplode(F.array(*(f"q{i}" for i in P))).alias("i", "q"))
    return _middle(long, (*KEYS, "i"), "q").groupBy(*KEYS).agg(*(F.expr(f"max(if(i = {i}, mid, null)) AS a{i}") for i in P))


def _sums(values: list[str], as_: str = "double") -> list[Column]:
    """Exact sums of integers and of their products, cast to as_: s_i, s_ij, and their number n."""
    exact = f"cast(sum(cast({{}} as decimal(20,0))) as {as_}) AS {{}}"
    named = [exact.format(v, f"s{i}") for i, v in enumerate(values)] + [exact.format(f"{values[i]} * {values[j]}", f"s{i}{j}") for i, j in LOWER_LEFT]
    return [F.expr(e) for e in ("count(1) AS n", *named)]


def _nearer_half(at: DataFrame, keys: tuple[str, ...], one: bool) -> DataFrame:
    """(keys, n, s_i, s_ij) of the rows of at(keys, bin, q_i) up to the lower median of bin: exact sums per bin, then over the bins; with one, the bins of all keys go to one task."""
    bins = at.groupBy(*keys, "bin").agg(*_sums([f"q{i}" for i in P], "decimal(30,0)"))
    run = Window.partitionBy(*keys).orderBy("bin")
    whole = (bins.repartition(1) if one else bins).withColumns({"before": F.sum("n").over(run) - F.col("n"), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return whole.filter(2 * F.col("before") < F.col("all")).groupBy(*keys).agg(*(F.expr(f"cast(sum({c}) as {'long' if c == 'n' else 'double'}) AS {c}") for c in bins.columns if c not in (*keys, "bin")))


def _moments(sums: DataFrame, keys: tuple[str, ...], factor: float) -> DataFrame:
    """(keys, m_i, c_ij) of sums(n, s_i, s_ij) of q_i."""
    return sums.selectExpr(*keys, *(f"s{i} / n / {UNIT} AS m{i}" for i in P), *(f"{factor!r}D * (s{i}{j} / n - s{i} / n * s{j} / n) / {UNIT**2} AS c{i}{j}" for i, j in LOWER_LEFT))


def _starts(rows: DataFrame, small: bool) -> DataFrame:
    """(KEYS, start, m_i, l_ij, det): medians with the MAD's diagonal, and the correlations of signs and of tanh scaled by it."""
    mid = pinned(_medians(rows))
    mad = _medians(_keyed(rows, mid, small).selectExpr(*KEYS, *(f"abs(q{i} - a{i}) AS q{i}" for i in P)))
    mad = mad.selectExpr(*KEYS, *(f"greatest(a{i} * 1.4826D, {FLOORS[i] * UNIT!r}D) AS b{i}" for i in P))
    scale = pinned(_keyed(mid, mad, small))
    centre = [f"a{i} / {UNIT} AS m{i}" for i in P]
    out = scale.selectExpr(*KEYS, "'median' AS start", *centre, *((f"pow(b{i} / {UNIT}, 2)" if i == j else "0D") + f" AS c{i}{j}" for i, j in LOWER_LEFT))
    z = _keyed(rows, scale, small).selectExpr(*KEYS, *(f"(q{i} - a{i}) / b{i} AS z{i}" for i in P))
    norm = "sqrt(" + " + ".join(f"z{i} * z{i}" for i in P) + " + 1e-12D)"
    for name, shape in (("sign", "z{i} / {norm}"), ("tanh", "tanh(z{i})")):
        fine = z.selectExpr(*KEYS, *("cast(round({} * {}) as bigint) AS v{}".format(shape.format(i=i, norm=norm), FINE, i) for i in P))
        both = _keyed(fine.groupBy(*KEYS).agg(*_sums([f"v{i}" for i in P])), scale, small)
        total = " + ".join(f"s{i}{i}" for i in P)
        out = out.unionByName(both.selectExpr(*KEYS, f"'{name}' AS start", *centre, *(f"s{i}{j} / nullif({total}, 0D) * {len(FEATURES)} * b{i} * b{j} / {UNIT**2} AS c{i}{j}" for i, j in LOWER_LEFT)))
    return _cholesky(out, (*KEYS, "start"), small)


def concentrated(rows: DataFrame, small: bool) -> DataFrame:
    """(KEYS, m_i, l_ij, det) of the half of each group of rows(KEYS, q_i) with the smallest determinant that the starts lead to."""
    keys = (*KEYS, "start")
    # A start is no half sample yet, so any determinant is a fall.
    best = pinned(_starts(rows, small).withColumns({"det": F.lit(float("inf")), "open": F.lit(True)}))
    values = [c for c in best.columns if c not in (*keys, "open")]
    one = small and best.count() <= ONE_TASK
    while not (live := best.filter("open")).isEmpty():
        at = _keyed(rows, live, small, "inner").withColumn("bin", F.floor(F.ln(_distance() + F.lit(1e-6)) * BINS))
        found = _cholesky(_moments(_nearer_half(at, keys, one), keys, HALF_FACTOR), keys, small)
        both = _keyed(best, found.select(*keys, F.struct(*values).alias("new")), small, "left", keys)
        falls = F.coalesce(F.col("new.det") < F.col("det") * (1 - FALL), F.lit(False))
        best = pinned(both.select(*keys, *(F.when(falls, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in values), falls.alias("open")))
    return best.groupBy(*KEYS).agg(F.min_by(F.struct(*values), F.struct("det", "start")).alias("b")).select(*KEYS, "b.*")


def fit(vectors: DataFrame) -> tuple[DataFrame, bool]:
    """Centre, Cholesky factor and determinant per group of vectors(g_lang, g_source, features); the flag says whether they may be broadcast."""
    rows = pinned(vectors.select(*KEYS, *(F.round(F.col(f) * UNIT).cast("long").alias(f"q{i}") for i, f in enumerate(FEATURES))))
    groups, n = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    small, rows = groups * len(STARTS) <= BROADCAST_GROUPS, rows.coalesce(n // TASK_ROWS + 1)
    far = _keyed(rows, concentrated(rows, small), small).withColumn("d2", _distance()).filter(F.col("d2") <= REWEIGHT_CHI2)
    reweighted = _cholesky(_moments(far.groupBy(*KEYS).agg(*_sums([f"q{i}" for i in P])), KEYS, 1.0), KEYS, small)
    return pinned(reweighted), small


def judged(stats: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """stats with base_failed, distance2 and kept."""
    rows = with_features(stats)
    params, small = fit(rows.filter("not base_failed").select(*KEYS, *FEATURES))
    far = _keyed(rows.withColumns({f"q{i}": F.round(F.col(f) * UNIT) for i, f in enumerate(FEATURES)}), params, small).withColumn("distance2", _distance())
    return far.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cutoff))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that are kept, columns as they were; statistics are made once, and rows to drop join by (id, hash of text and group)."""
    drop = pinned(judged(pinned(statistics(docs, id_col, text, lang, source)), cutoff).filter("not kept").select(F.col("id").alias("drop_id"), F.col("h").alias("drop_h")).distinct())
    few = drop.count() <= BROADCAST_REJECTED
    mark = fresh(docs, "row_hash")
    marked = docs.withColumn(mark, row_hash(text, lang, source))
    return marked.join(F.broadcast(drop) if few else spread(drop), marked[id_col].eqNullSafe(F.col("drop_id")) & (marked[mark] == F.col("drop_h")), "left_anti").drop(mark)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = pinned(statistics(table(spark, sf_dir, "documents")))
    return judged(stats).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2"
    )

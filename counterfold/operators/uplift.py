"""Treatment effects: setup checks, estimators, and how to compare them."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfold.errors import refuse_if
from counterfold.functions.hashing import hash32
from counterfold.functions.statistics import correlation
from counterfold.operators.ordering import exact_quantiles, prefix_sums
from counterfold.operators.sampling import sample_exact
from counterfold.session import durable

# Thresholds a setup is judged by.
CORRELATION_LIMIT = 0.99
DEPENDENCE_LIMIT = 0.995
DEPENDENCE_ROWS = 20_000
DEPENDENCE_BINS = 2_048  # fine enough for a split to land on a rule's bound
OVERLAP_EPSILON = 1e-3
IMBALANCE = 0.01
DEGENERATE = 1e-12


def check_lineage(treatment: str, outcome: str, lineage: dict[str, list[str]] | None) -> None:
    """Refuse a treatment that the declared lineage derives from the outcome."""
    sources = {treatment}
    # the closure: add the inputs of all known sources until nothing is new
    while more := {c for s in sources for c in (lineage or {}).get(s, ())} - sources:
        sources |= more
    refuse_if(outcome in sources, "treatment_from_outcome", f"{treatment} is derived from {outcome}")


def causal_diagnostics(
    units: DataFrame, covariates: list[str], propensity: str | None = None,
    treatment: str = "treatment", outcome: str = "outcome",
) -> DataFrame:
    """One row of assumption checks, from one aggregation."""
    t, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    aggs = [
        F.count("*").alias("n_units"), F.count_distinct(treatment).alias("n_arms"),
        F.avg(t).alias("treatment_balance"),
        F.coalesce(correlation(t, y), F.lit(0.0)).alias("outcome_treatment_correlation"),
    ]
    for c in covariates:
        x = F.col(c).cast("double")
        aggs.append(F.coalesce(F.abs(correlation(t, x)), F.lit(0.0)).alias(f"abs_corr_{c}"))
    if propensity is not None:
        p = F.col(propensity)
        aggs += [F.min(p).alias("propensity_min"), F.max(p).alias("propensity_max"),
                 F.count_if((p < OVERLAP_EPSILON) | (p > 1 - OVERLAP_EPSILON))
                 .alias("logged_propensity_overlap_violations")]
    balance = F.col("treatment_balance")
    return units.agg(*aggs).withColumn(
        "severe_imbalance",
        ((balance > 0) & (balance < IMBALANCE)) | ((balance > 1 - IMBALANCE) & (balance < 1)))


def validate_setup(
    units: DataFrame, covariates: list[str], propensity: str | None = None, treatment: str = "treatment",
    outcome: str = "outcome", lineage: dict[str, list[str]] | None = None, strict: bool = True,
) -> DataFrame:
    """Diagnostics, refused where no effect is identified."""
    check_lineage(treatment, outcome, lineage)
    report = causal_diagnostics(units, covariates, propensity, treatment, outcome)
    row = report.first().asDict()
    if strict:
        refuse_if(row["n_arms"] < 2, "single_arm", "no contrast exists", arms=row["n_arms"])
        refuse_if(abs(row["outcome_treatment_correlation"]) >= CORRELATION_LIMIT, "treatment_is_outcome",
                  "the treatment is nearly the outcome", corr=row["outcome_treatment_correlation"])
        bad = [c for c in covariates if row[f"abs_corr_{c}"] >= CORRELATION_LIMIT]
        refuse_if(bool(bad), "covariate_is_treatment", "a covariate determines the treatment", covariates=bad)
    return report


def functional_dependence(
    units: DataFrame, covariates: list[str], treatment: str = "treatment", outcome: str = "outcome",
    key: str = "round_id", seed: int = 42, max_rows: int = DEPENDENCE_ROWS,
) -> DataFrame:
    """Cross-validated accuracy of a shallow tree that predicts the treatment.

    Ratios and differences with the outcome are offered as features: a rule such
    as "outcome / x above a bound" shows up there and nowhere else.
    """
    sampled = sample_exact(units.select(key, treatment, outcome, *covariates), max_rows, seed, key)
    y = F.col(outcome).cast("double")
    clean = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull(), 0.0).otherwise(c)
    columns = {"f_y": y}
    for c in covariates:
        x = F.col(c).cast("double")
        columns |= {f"f_{c}": x, f"r_{c}": F.try_divide(y, x + 1e-9), f"d_{c}": y - x}
    data = sampled.select(
        F.col(treatment).cast("double").alias("label"),
        F.pmod(hash32(seed, key), F.lit(3)).alias("fold"), *[clean(v).alias(k) for k, v in columns.items()])
    data = VectorAssembler(inputCols=list(columns), outputCol="features").transform(data).select("label", "fold", "features")
    scored = None
    for fold in range(3):
        tree = DecisionTreeClassifier(maxDepth=3, maxBins=DEPENDENCE_BINS, seed=seed).fit(data.filter(F.col("fold") != fold))
        part = tree.transform(data.filter(F.col("fold") == fold)).select("fold", "label", "prediction")
        scored = part if scored is None else scored.unionByName(part)
    folds = scored.groupBy("fold").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a"))
    return folds.agg(F.avg("a").alias("accuracy"), F.count("*").alias("n_folds")).withColumn(
        "dependent", F.col("accuracy") >= DEPENDENCE_LIMIT)


# ------------------------------------------------------------------ estimators


def _forest(label: str, prediction: str, trees: int, depth: int, seed: int, weight: str | None = None):
    kw = {"weightCol": weight} if weight else {}
    return RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol=prediction,
                                 numTrees=trees, maxDepth=depth, seed=seed, **kw)


def _features(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features")


def s_learner(
    train: DataFrame, score: DataFrame, covariates: list[str], trees: int = 100, depth: int = 10, seed: int = 42,
    treatment: str = "treatment", outcome: str = "outcome",
) -> DataFrame:
    """One forest on covariates and treatment; the effect is a difference of two readings."""
    cols = [*covariates, "__t"]
    model = _forest(outcome, "__y", trees, depth, seed).fit(
        _features(cols).transform(train.withColumn("__t", F.col(treatment).cast("double"))))
    out = score.select("round_id", *covariates)
    for arm in (0, 1):
        out = model.transform(_features(cols).transform(out.withColumn("__t", F.lit(float(arm))))).withColumnRenamed(
            "__y", f"__y{arm}").drop("features", "__t")
    return out.select("round_id", F.lit("s_learner").alias("estimator"), (F.col("__y1") - F.col("__y0")).alias("cate"))


def x_learner(
    train: DataFrame, score: DataFrame, covariates: list[str], trees: int = 100, depth: int = 10, seed: int = 42,
    treatment: str = "treatment", outcome: str = "outcome",
) -> DataFrame:
    """Per-arm outcome forests, imputed effects, and a propensity-weighted blend."""
    data = _features(covariates).transform(train.withColumn("__t", F.col(treatment).cast("double")))
    arm = lambda a: data.filter(F.col("__t") == a)
    mu0 = _forest(outcome, "__mu", trees, depth, seed).fit(arm(0.0))
    mu1 = _forest(outcome, "__mu", trees, depth, seed + 1).fit(arm(1.0))
    d1 = mu0.transform(arm(1.0)).withColumn("__d", F.col(outcome) - F.col("__mu")).drop("__mu")
    d0 = mu1.transform(arm(0.0)).withColumn("__d", F.col("__mu") - F.col(outcome)).drop("__mu")
    tau1 = _forest("__d", "__tau1", trees, depth, seed + 2).fit(d1)
    tau0 = _forest("__d", "__tau0", trees, depth, seed + 3).fit(d0)
    g = LogisticRegression(featuresCol="features", labelCol="__t", probabilityCol="__g", maxIter=50).fit(data)
    from pyspark.ml.functions import vector_to_array

    out = _features(covariates).transform(score.select("round_id", *covariates))
    out = tau0.transform(tau1.transform(g.transform(out).withColumn("__p", vector_to_array("__g")[1]).drop("prediction")))
    blend = F.col("__p") * F.col("__tau0") + (1 - F.col("__p")) * F.col("__tau1")
    return out.select("round_id", F.lit("x_learner").alias("estimator"), blend.alias("cate"))


def residual_learner(
    train: DataFrame, score: DataFrame, covariates: list[str], trees: int = 100, depth: int = 10, seed: int = 42,
    treatment: str = "treatment", outcome: str = "outcome", folds: int = 2,
) -> DataFrame:
    """Residual-on-residual effects with cross-fitted forests, labelled ``rlearner_rf``."""
    data = _features(covariates).transform(
        train.withColumn("__t", F.col(treatment).cast("double"))
        .withColumn("__f", F.pmod(hash32(seed, "round_id"), F.lit(folds))))
    residuals = None
    for fold in range(folds):
        rest, mine = data.filter(F.col("__f") != fold), data.filter(F.col("__f") == fold)
        m = _forest(outcome, "__m", trees, depth, seed + fold).fit(rest)
        e = _forest("__t", "__e", trees, depth, seed + folds + fold).fit(rest)
        part = e.transform(m.transform(mine))
        residuals = part if residuals is None else residuals.unionByName(part)
    tr = F.col("__t") - F.col("__e")
    target = residuals.withColumn("__w", tr * tr).filter(F.col("__w") > 1e-6).withColumn(
        "__z", (F.col(outcome) - F.col("__m")) / tr)
    model = _forest("__z", "cate", trees, depth, seed + 9, weight="__w").fit(target)
    out = model.transform(_features(covariates).transform(score.select("round_id", *covariates)))
    return out.select("round_id", F.lit("rlearner_rf").alias("estimator"), "cate")


# ------------------------------------------------------------------ comparison


def cate_summary(cate: DataFrame, by: str = "estimator") -> DataFrame:
    """Distribution of the estimated effects, with a constant estimator made visible.

    Quartiles are searched by rank for each estimator (of which there are a
    handful; a null one counts as one of them).  The searches scan the effects many times, so these are written first.
    """
    cate = durable(cate.select(by, "cate"))
    c = F.col("cate")
    moments = cate.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"),
        F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.avg((c > 0).cast("double")).alias("fraction_positive"),
    ).withColumn("is_degenerate", F.col("variance") < DEGENERATE)
    quartiles = (0.25, 0.5, 0.75)
    names = [r[0] for r in cate.select(by).distinct().collect()]
    rows = [(n, *exact_quantiles(cate.filter(F.col(by).eqNullSafe(F.lit(n))), "cate", quartiles)) for n in names]
    found = cate.sparkSession.createDataFrame(
        rows, f"__by {cate.schema[by].dataType.simpleString()}, q25 double, median double, q75 double")
    return moments.join(F.broadcast(found), F.col(by).eqNullSafe(F.col("__by"))).drop("__by")


def assert_finite(cate: DataFrame) -> DataFrame:
    row = cate.agg(F.count("*").alias("n"), F.count_if(
        F.col("cate").isNull() | F.isnan("cate") | (F.abs("cate") == float("inf"))).alias("bad")).first()
    refuse_if(row["n"] == 0, "no_effects", "the effect table is empty")
    refuse_if(row["bad"] > 0, "non_finite_effects", "effects are not all finite", rows=row["bad"])
    return cate


def qini(
    effects: DataFrame, key: str = "round_id", treatment: str = "treatment", outcome: str = "outcome",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Normalised area between the targeting curve and random targeting.

    Units are ordered by descending effect (ties by key); the cumulative sums of
    both arms come from a distributed prefix sum.
    """
    t = F.col(treatment).cast("double")
    base = effects.select(
        *by, key, (-F.col("cate")).alias("__o"), t.alias("__t"), (1 - t).alias("__c"),
        (t * F.col(outcome)).alias("__yt"), ((1 - t) * F.col(outcome)).alias("__yc"))
    cum = prefix_sums(base, ["__o", key], {"nt": "__t", "nc": "__c", "yt": "__yt", "yc": "__yc"}, "__i", by)
    ratio = F.when(F.col("nc") > 0, F.col("nt") / F.col("nc")).otherwise(0.0)
    curve = cum.withColumn("u", F.col("yt") - F.col("yc") * ratio)
    # the random line sums to n * u_last / 2, whatever n is
    totals = curve.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("u").alias("area"), F.max_by("u", "__i").alias("last"))
    denominator = F.abs("last") * F.col("n") / 2.0
    return totals.select(*by, "n", F.when(denominator < DEGENERATE, 0.0).otherwise(
        (F.col("area") - F.col("last") * F.col("n") / 2.0) / denominator).alias("qini"))


def compare_effects(cate: DataFrame, units: DataFrame) -> DataFrame:
    """Summary and Qini per estimator in one table."""
    assert_finite(cate)
    joined = cate.join(units.select("round_id", "treatment", "outcome"), "round_id")
    return cate_summary(cate).join(qini(joined, by=("estimator",)).drop("n"), "estimator")

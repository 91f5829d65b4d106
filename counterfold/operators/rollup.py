"""Comparison tables over result rows: never two experiments in one cell, never
a missing value turned into a zero, never a lost seed left unsaid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from counterfold.errors import refuse_if

# Fixed values of the tables.
VARIANT_SUFFIXES = ("_main", "_ablation_raw", "_ablation_cate")
WEIGHTED = ("ipw", "snipw", "dr", "mrdr")
LOW_ESS = 100.0
HEADLINE = {"state_source": "gnn_embeddings", "cate_reward_weight": 0.0}
RAW_STATE = "raw_features"
CELL = ["experiment", "agent", "state_source", "cate_reward_weight", "estimator"]


def experiment_family(experiment: str | Column = "experiment") -> Column:
    """The experiment without its variant suffix; a bare suffix stays as it is."""
    col = F.col(experiment) if isinstance(experiment, str) else experiment
    return F.regexp_replace(col, f"(?<=.)({'|'.join(VARIANT_SUFFIXES)})$", "")


def aggregate_cells(results: DataFrame, attempted: DataFrame | None = None) -> DataFrame:
    """One row per (experiment, agent, state, weight, estimator), over its seeds.

    ``attempted``: (experiment, seed, run_status) of launched runs; seeds that left
    no result row count as attempted and lost.
    """
    spark = results.sparkSession
    rows = results.withColumn("status", F.coalesce("status", F.lit("ok")))
    if attempted is None:
        attempted = spark.createDataFrame([], "experiment string, seed long, run_status string")
    usable = F.col("status") == "ok"
    cells = rows.groupBy(*CELL).agg(
        F.collect_set(F.when(usable, F.col("seed"))).alias("usable_seeds"),
        F.collect_set("seed").alias("seen_seeds"),
        F.avg(F.when(usable, F.col("value"))).alias("mean"),
        F.coalesce(F.stddev_samp(F.when(usable, F.col("value"))), F.lit(0.0)).alias("std"),
        # an interval missing for one seed leaves the mean interval undefined
        F.when(F.count_if(usable & F.col("ci_lower").isNull()) == 0,
               F.avg(F.when(usable, F.col("ci_lower")))).alias("ci_lower"),
        F.when(F.count_if(usable & F.col("ci_upper").isNull()) == 0,
               F.avg(F.when(usable, F.col("ci_upper")))).alias("ci_upper"),
        F.avg(F.when(usable, F.col("effective_sample_size"))).alias("ess"),
        (F.count(F.when(usable, F.col("effective_sample_size"))) < F.count_if(usable)).alias("__some_ess_missing"),
        F.max(F.when(usable, F.col("n_test_rounds"))).alias("__n_usable_rounds"),
        F.max("n_test_rounds").alias("__n_rounds"),
        F.count_if(usable).alias("__n_ok"),
        F.collect_set(F.when(~usable, F.concat_ws(":", "status", F.col("seed").cast("string")))).alias("__failed"),
        F.collect_set(F.when(~usable, F.col("status"))).alias("__failed_statuses"),
        F.array_sort(F.collect_set(F.when(~usable, F.col("detail")))).alias("details"),
    )
    runs = attempted.groupBy("experiment").agg(F.collect_set(F.struct("seed", "run_status")).alias("runs"))
    out = cells.join(runs, "experiment", "left").withColumn(
        "runs", F.coalesce("runs", F.array().cast("array<struct<seed:bigint,run_status:string>>")))
    lost = F.filter("runs", lambda r: ~F.array_contains("seen_seeds", r["seed"]))
    out = out.withColumn("__lost", lost)
    failures = F.array_sort(F.concat("__failed", F.transform(
        "__lost", lambda r: F.concat(F.lit("run_"), r["run_status"], F.lit(":"), r["seed"].cast("string")))))
    reasons = F.array_sort(F.array_distinct(F.concat("__failed_statuses", F.transform(
        "__lost", lambda r: F.concat(F.lit("run_"), r["run_status"])))))
    n_usable = F.size("usable_seeds")
    n_attempted = F.size(F.array_union("seen_seeds", F.transform("runs", lambda r: r["seed"])))
    out = out.withColumn("n_usable", n_usable).withColumn("n_attempted", n_attempted).withColumn("reasons", reasons)
    status = (
        F.when(F.col("__n_ok") > 0, F.when(F.col("n_usable") < F.col("n_attempted"), "partial").otherwise("ok"))
        .when(F.size("reasons") == 1, F.element_at("reasons", 1)).otherwise("mixed_failure")
    )
    return out.select(
        *CELL, "mean", F.when(F.col("__n_ok") > 0, F.col("std")).otherwise(0.0).alias("std"),
        "ci_lower", "ci_upper", "ess",
        F.when(F.col("__n_ok") > 0, F.col("__some_ess_missing")).otherwise(True).alias("ess_missing"),
        "n_usable", "n_attempted",
        F.array_join(F.array_sort(F.col("usable_seeds")).cast("array<string>"), ",").alias("seeds"),
        F.array_join(failures, ",").alias("failures"), "details",
        F.coalesce("__n_usable_rounds", "__n_rounds").alias("n_test"), status.alias("status"),
        ((F.col("__n_ok") > 0) & (F.col("n_usable") < F.col("n_attempted"))).alias("partial"),
    )


def table_groups(cells: DataFrame) -> DataFrame:
    """``(experiment, table_group)``: a family shares a table only if every column
    (state, weight) belongs to one of its experiments; otherwise it is split."""
    owners = cells.select(
        "experiment", "state_source", "cate_reward_weight", experiment_family().alias("family")).distinct()
    clash = owners.groupBy("family", "state_source", "cate_reward_weight").agg(
        F.count_distinct("experiment").alias("n")).groupBy("family").agg((F.max("n") > 1).alias("split"))
    return owners.select("experiment", "family").distinct().join(clash, "family").select(
        "experiment", "family", F.when(F.col("split"), F.col("experiment")).otherwise(F.col("family")).alias("table_group"))


def one_group(cells: DataFrame) -> DataFrame:
    """Refuse cells that span experiments: there is no right silent choice."""
    names = [r[0] for r in cells.select("experiment").distinct().limit(11).collect()]
    refuse_if(len(names) > 1, "mixed_experiments", "one table describes one experiment", experiments=sorted(names))
    return cells


def _headline(cells: DataFrame, state: str = HEADLINE["state_source"], weight: float = 0.0) -> DataFrame:
    return cells.filter((F.col("state_source") == state) & (F.col("cate_reward_weight") == weight))


def with_markers(cells: DataFrame) -> DataFrame:
    """How a cell is to be shown: value, n.i., n/a, or partial n/m."""
    marker = (
        F.when(F.col("status") == "not_identifiable", "n.i.")
        .when(~F.col("status").isin("ok", "partial"), "n/a")
        .when(F.col("partial"), F.concat_ws("/", F.col("n_usable"), F.col("n_attempted")))
        .otherwise("")
    )
    low = F.col("estimator").isin(*WEIGHTED) & (F.col("ess") < LOW_ESS) & (F.col("status") == "ok")
    return cells.withColumn("marker", marker).withColumn("low_ess", F.coalesce(low, F.lit(False)))


def caption_ranges(cells: DataFrame, by: tuple[str, ...] = ("experiment",)) -> DataFrame:
    """Seed-count and round ranges a caption may state."""
    shown = F.col("status").isin("ok", "partial")
    return cells.groupBy(*by).agg(
        F.min(F.when(shown, F.col("n_usable"))).alias("seeds_min"),
        F.max(F.when(shown, F.col("n_usable"))).alias("seeds_max"),
        F.min("n_test").alias("rounds_min"), F.max("n_test").alias("rounds_max"))


def flag_best(cells: DataFrame, by: tuple[str, ...] = ("experiment",)) -> DataFrame:
    """The best eligible cell per estimator: complete, and not on a handful of rounds."""
    eligible = (F.col("status") == "ok") & ~F.col("partial") & ~(
        F.col("estimator").isin(*WEIGHTED) & F.coalesce(F.col("ess") < LOW_ESS, F.lit(False)))
    top = F.max(F.when(eligible, F.col("mean"))).over(Window.partitionBy(*by, "estimator"))
    best = (F.col("status") == "ok") & ~F.col("partial") & (F.abs(F.col("mean") - top) < 1e-12)
    return cells.withColumn("is_best", F.coalesce(best, F.lit(False)))


def value_table(cells: DataFrame, estimators: list[str]) -> DataFrame:
    """Policy values: one row per (experiment, agent), one column set per estimator."""
    marked = flag_best(with_markers(_headline(cells)))
    wide = marked.groupBy("experiment", "agent").pivot("estimator", estimators).agg(
        F.first("mean").alias("value"), F.first("marker").alias("marker"), F.first("is_best").alias("best"))
    ess = marked.groupBy("experiment", "agent").agg(F.max("ess").alias("row_ess"))
    return wide.join(ess, ["experiment", "agent"])


def ablation_table(cells: DataFrame, estimator: str) -> DataFrame:
    """Arms of a family side by side; fewer than two configurations are refused."""
    mine = cells.filter(F.col("estimator") == estimator).withColumn(
        "configuration", F.concat_ws("@", "state_source", F.col("cate_reward_weight").cast("string"))
    ).withColumn("family", experiment_family())
    configurations = sorted(r[0] for r in mine.select("configuration").distinct().collect())
    refuse_if(len(configurations) < 2, "one_configuration", "an ablation compares at least two",
              configurations=configurations)
    clash = mine.groupBy("family", "configuration", "agent").agg(F.count_distinct("experiment").alias("n"))
    refuse_if(not clash.filter("n > 1").isEmpty(), "mixed_experiments", "a column belongs to several experiments")
    return mine.groupBy("family", "agent").pivot("configuration", configurations).agg(F.first("mean"))


def validation_errors(cells: DataFrame) -> DataFrame:
    """Signed error of each estimator against the exact value of the same agent."""
    mine = _headline(cells)
    truth = mine.filter((F.col("estimator") == "exact") & (F.col("status") == "ok")).select(
        "experiment", "agent", F.col("mean").alias("exact"))
    return mine.filter(F.col("estimator").isin("snipw", "dm", "dr", "mrdr")).join(
        truth, ["experiment", "agent"]).select(
        "experiment", "agent", "estimator", "exact", "mean", "status", "partial",
        F.when(F.col("status").isin("ok", "partial"), F.col("mean") - F.col("exact")).alias("error"))


def validation_table(cells: DataFrame) -> DataFrame:
    """Mean absolute error per estimator over complete cells."""
    return validation_errors(cells).groupBy("experiment", "estimator").agg(
        F.avg(F.when((F.col("status") == "ok") & ~F.col("partial"), F.abs("error"))).alias("mae"),
        F.count(F.when((F.col("status") == "ok") & ~F.col("partial"), F.col("error"))).alias("n_agents"))


def dataset_table(summaries: DataFrame) -> DataFrame:
    """Dataset summaries turned to one row per property, a column per dataset."""
    text = {
        "Interactions": F.col("n_interactions").cast("string"), "Users": F.col("n_users").cast("string"),
        "Items (actions)": F.col("n_actions").cast("string"),
        "Mean reward": F.format_string("%.5f", F.col("mean_reward")),
        "Reward definition": F.col("reward_definition"),
        "Train / Val / Test": F.concat_ws(" / ", "n_train", "n_validation", "n_test"),
        "Split strategy": F.col("split_strategy"),
        "Logged propensities": F.when(F.col("propensity_is_constant"), "No (uniform)").otherwise("Yes"),
    }
    long = summaries.select("dataset", F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(k).alias("property"), v.alias("text"))
        for i, (k, v) in enumerate(text.items())])).alias("p")).select("dataset", "p.*")
    names = sorted(r[0] for r in summaries.select("dataset").distinct().collect())
    return long.groupBy("position", "property").pivot("dataset", names).agg(F.first("text")).orderBy("position")


# ------------------------------------------------------------------ claims


def ranking(cells: DataFrame) -> DataFrame:
    """Agents ranked by value within (experiment, estimator)."""
    shown = _headline(cells).filter(F.col("status").isin("ok", "partial"))
    w = Window.partitionBy("experiment", "estimator").orderBy(F.desc("mean"), "agent")
    return shown.withColumn("rank", F.row_number().over(w))


def best_agents(cells: DataFrame) -> DataFrame:
    """Best complete agent per estimator, or 'not established'."""
    ranked = ranking(cells)
    complete = F.when(~F.col("partial"), F.struct(-F.col("rank"), F.col("agent").alias("agent")))
    return ranked.groupBy("experiment", "estimator").agg(F.max(complete).alias("b")).select(
        "experiment", "estimator", F.lit("best").alias("claim"), F.col("b.agent").alias("subject"),
        F.when(F.col("b").isNull(), "NOT ESTABLISHED").otherwise("ESTABLISHED").alias("verdict"))


def outperforms(cells: DataFrame, challenger: str, incumbent: str) -> DataFrame:
    """Verdict on 'challenger beats incumbent'; lost seeds on a side leave it open."""
    shown = ranking(cells).select("experiment", "estimator", "agent", "mean", "partial")
    a = shown.filter(F.col("agent") == challenger).select(
        "experiment", "estimator", F.col("mean").alias("ma"), F.col("partial").alias("pa"))
    b = shown.filter(F.col("agent") == incumbent).select(
        "experiment", "estimator", F.col("mean").alias("mb"), F.col("partial").alias("pb"))
    return a.join(b, ["experiment", "estimator"]).select(
        "experiment", "estimator", F.lit("outperforms").alias("claim"),
        F.lit(f"{challenger}>{incumbent}").alias("subject"),
        F.when(F.col("pa") | F.col("pb"), "NOT ESTABLISHED")
        .when(F.col("ma") > F.col("mb"), "SUPPORTED").otherwise("NOT SUPPORTED").alias("verdict"))


def against_random(cells: DataFrame, random_agent: str = "random") -> DataFrame:
    """Every agent against the random baseline."""
    shown = ranking(cells)
    base = shown.filter(F.col("agent") == random_agent).select(
        "experiment", "estimator", F.col("mean").alias("base"), F.col("partial").alias("bp"))
    verdict = (
        F.when(F.col("bp") | F.col("partial"), "NOT ESTABLISHED")
        .when(F.col("mean") > F.col("base"), "SUPPORTED").otherwise("NOT SUPPORTED")
    )
    return shown.filter(F.col("agent") != random_agent).join(base, ["experiment", "estimator"]).select(
        "experiment", "estimator", F.lit("beats_random").alias("claim"), F.col("agent").alias("subject"),
        verdict.alias("verdict"))


def ess_caveats(cells: DataFrame) -> DataFrame:
    """Weighted estimates resting on under 1% of their rounds, or on an unknown ESS."""
    mine = ranking(cells).filter(F.col("estimator").isin(*WEIGHTED))
    verdict = (
        F.when(F.col("ess").isNull() | F.col("ess_missing"), "ESS NOT RECORDED")
        .when(F.col("ess") < 0.01 * F.col("n_test"), "ESS BELOW 1%")
    )
    return mine.withColumn("verdict", verdict).filter("verdict IS NOT NULL").select(
        "experiment", "estimator", F.lit("ess").alias("claim"), F.col("agent").alias("subject"), "verdict")


def ablation_verdicts(cells: DataFrame) -> DataFrame:
    """Does the learned state help, does reward shaping help - per family and agent.

    Only arms of one family meet, and a family whose columns clash is left out.
    """
    groups = table_groups(cells).filter(F.col("family") == F.col("table_group")).select("experiment", "family")
    mine = cells.join(groups, "experiment")
    side = lambda df, n: df.select(
        F.col("family").alias("experiment"), "estimator", "agent", F.col("mean").alias(f"m{n}"),
        F.col("status").isin("ok", "partial").alias(f"v{n}"), F.col("partial").alias(f"p{n}"))
    learned = _headline(mine)
    raw = _headline(mine, RAW_STATE)
    shaped = mine.filter(F.col("cate_reward_weight") > 0)

    def contrast(left: DataFrame, right: DataFrame, claim: str) -> DataFrame:
        joined = side(left, "l").join(side(right, "r"), ["experiment", "estimator", "agent"])
        verdict = (
            F.when(~F.col("vl") | ~F.col("vr"), "NO VERDICT: no value")
            .when(F.col("pl") | F.col("pr"), "NO VERDICT: lost seeds")
            .when(F.col("mr") > F.col("ml"), "HELPS").otherwise("DOES NOT HELP")
        )
        return joined.select("experiment", "estimator", F.lit(claim).alias("claim"),
                             F.col("agent").alias("subject"), verdict.alias("verdict"))

    return contrast(raw, learned, "graph_state").unionByName(contrast(learned, shaped, "reward_shaping"))


def claims_check(cells: DataFrame, pairs: list[tuple[str, str]] = (), random_agent: str = "random") -> DataFrame:
    """All claims with their verdicts, one row each."""
    out = best_agents(cells).unionByName(against_random(cells, random_agent))
    out = out.unionByName(ess_caveats(cells)).unionByName(ablation_verdicts(cells))
    for challenger, incumbent in pairs:
        out = out.unionByName(outperforms(cells, challenger, incumbent))
    return out


def value_ladder(report: DataFrame, references: DataFrame) -> DataFrame:
    """Agents and reference lines in one ordered table."""
    agents = report.select("agent", "value", "n_distinct_actions", F.lit("agent").alias("kind"))
    lines = references.select("agent", "value", F.lit(None).cast("long").alias("n_distinct_actions"),
                              F.lit("reference").alias("kind"))
    return agents.unionByName(lines).orderBy("value", "agent")


def missing_runs(variants: DataFrame, seeds: list[int], completed: DataFrame) -> DataFrame:
    """The experiment plan: every variant with every seed, less what is done."""
    planned = variants.select("variant", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])).alias("seed"))
    return planned.join(completed.select("variant", "seed"), ["variant", "seed"], "left_anti")

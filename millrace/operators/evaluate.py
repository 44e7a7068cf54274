"""Paired measurement of two runs, comparison of metrics, decision gates, label sheets of blind ratings, judged scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import names as N
from millrace.functions.text import seeded
from millrace.operators import stats
from millrace.operators.joins import aligned, violations


def paired_runs(data: DataFrame, run: DataFrame, base: DataFrame) -> DataFrame:
    """data (id, gold, opt, project, state, prefixes) with both runs' (id, pred): id, project, opt, state, f1, base_f1, bare_f1,
    base_bare_f1, exact. The three tables must have the same ids; a null prediction fails, an empty one scores 0."""
    both = aligned(aligned(data, run.select("id", F.col("pred").alias("_run")), "id"), base.select("id", F.col("pred").alias("_base")), "id")
    both = violations(both, F.col("_run").isNull() | F.col("_base").isNull(), "a prediction is null")
    g = N.tokens(F.col("gold"))
    out = {"f1": N.f1(N.tokens(F.col("_run")), g), "base_f1": N.f1(N.tokens(F.col("_base")), g), "bare_f1": N.f1_without(N.tokens(F.col("_run")), g, F.col("prefixes")), "base_bare_f1": N.f1_without(N.tokens(F.col("_base")), g, F.col("prefixes"))}
    return both.select("id", "project", "opt", "state", *[c.alias(k) for k, c in out.items()], (F.col("_run") == F.col("gold")).alias("exact"))


def paired_summary(rows: DataFrame, opts: list[str], states: list[str]) -> DataFrame:
    """(opt, state, n, f1, base_f1, diff, bare_f1, base_bare_f1, n_exact): all cells of opts and states and their margins `all`;
    cells without rows have n 0 and null means."""
    mean = lambda c: F.avg(c).alias(c)
    sets = rows.cube("opt", "state").agg(F.grouping_id("opt", "state").alias("_g"), F.count(F.lit(1)).alias("n"), mean("f1"), mean("base_f1"), mean("bare_f1"), mean("base_bare_f1"), F.count_if("exact").alias("n_exact"))
    sets = sets.select(F.when(F.col("_g").isin(2, 3), "all").otherwise(F.col("opt")).alias("opt"), F.when(F.col("_g").isin(1, 3), "all").otherwise(F.col("state")).alias("state"), *[c for c in sets.columns if c not in ("opt", "state", "_g")])
    cells = F.explode(F.array(*[F.struct(F.lit(o).alias("opt"), F.lit(s).alias("state")) for o in [*opts, "all"] for s in [*states, "all"]])).alias("c")
    grid = rows.sparkSession.range(1).select(cells).select("c.*")
    out = grid.join(sets, ["opt", "state"], "left")
    return out.select("opt", "state", F.coalesce("n", F.lit(0)).alias("n"), "f1", "base_f1", (F.col("f1") - F.col("base_f1")).alias("diff"), "bare_f1", "base_bare_f1", F.coalesce("n_exact", F.lit(0)).alias("n_exact"))


def cluster_interval(rows: DataFrame, cluster: str, value: Column, repeats: int, seed: str, places: tuple[int, int] | None = None) -> DataFrame:
    """One row: n_clusters, diff (mean over rows), low, high: clusters are drawn, the statistic is the sum over the rows drawn by their
    number. places: of the sorted repeats, from 0; else those of the 95 % interval."""
    units = rows.groupBy(F.col(cluster).alias("unit")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("weight")).withColumn("scope", F.lit(0))
    samples = stats.bootstrap_means(units, "scope", "total", "weight", repeats, seed)
    ends = stats.interval(samples, "scope", *(places or stats.places(repeats)))
    mean = units.groupBy("scope").agg(F.count(F.lit(1)).alias("n_clusters"), (F.sum("total") / F.sum("weight")).alias("diff"))
    return mean.join(ends, "scope").select("n_clusters", "diff", "low", "high")


METRICS = ("name_f1", "bare_f1", "narrow_f1", "folded_f1", "exact")


def metric_scores(rows: DataFrame) -> DataFrame:
    """rows (id, gold, pred, prefixes) with five scores of a name: METRICS."""
    p, g = N.tokens(F.coalesce("pred", F.lit(""))), N.tokens(F.col("gold"))
    scores = (N.f1(p, g), N.f1_without(p, g, F.col("prefixes")), N.narrow_f1(p, g), N.f1(N.fold(p, N.SYNONYMS), N.fold(g, N.SYNONYMS)), (F.col("pred") == F.col("gold")).cast("double"))
    return rows.select(*rows.columns, *[s.alias(m) for m, s in zip(METRICS, scores, strict=True)])


def metric_comparison(scored: DataFrame) -> DataFrame:
    """(metric, n, mean, diff, n_up, n_down): means, and against name_f1 the mean difference and the rows that rise and fall. A
    difference of definitions is no gain of a model."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in METRICS:
        d = F.col(m) - F.col("name_f1")
        aggs += [F.avg(m).alias(f"{m}.mean"), F.avg(d).alias(f"{m}.diff"), F.count_if(d > 1e-12).alias(f"{m}.up"), F.count_if(d < -1e-12).alias(f"{m}.down")]
    one = scored.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col("n"), F.col(f"`{m}.mean`").alias("mean"), F.col(f"`{m}.diff`").alias("diff"), F.col(f"`{m}.up`").alias("n_up"), F.col(f"`{m}.down`").alias("n_down")) for m in METRICS])
    return one.select(F.inline(cells))


def screening_gate(delta: Column, low: Column, valid_new: Column, valid_old: Column, least: float = 0.01) -> Column:
    """A run passes if it gains enough, the interval lies above 0, and no fewer of its answers are valid; null counts as no."""
    return F.coalesce((delta >= least) & (low > 0) & (valid_new >= valid_old), F.lit(False))


LABELS = ("right", "partly", "wrong", "unknown")
INVENTED = ("none", "some", "unknown")


def label_summary(labels: DataFrame, system: str, dims: tuple[str, ...], invented: str = "invented") -> DataFrame:
    """Per system: n, mean (of a score from 0 to 1: a point for each right field, half for partly, one for nothing invented), decided
    (share of fields that are not unknown), some_rate, risk_rate (invented some, or not known)."""
    point = lambda c: F.when(F.col(c) == "right", 1.0).when(F.col(c) == "partly", 0.5).otherwise(0.0)
    fields = [*dims, invented]
    score = sum((point(d) for d in dims[1:]), point(dims[0])) + F.when(F.col(invented) == "none", 1.0).otherwise(0.0)
    decided = sum(((F.col(c) != "unknown").cast("int") for c in fields[1:]), (F.col(fields[0]) != "unknown").cast("int"))
    n = F.count(F.lit(1))
    some = F.count_if(F.col(invented) == "some")
    return labels.groupBy(system).agg(n.alias("n"), (F.sum(score) / len(fields) / n).alias("mean"), (F.sum(decided) / len(fields) / n).alias("decided"), (some / n).alias("some_rate"), ((some + F.count_if(F.col(invented) == "unknown")) / n).alias("risk_rate"))


def safety_gates(summary: DataFrame, system: str, reference: str) -> DataFrame:
    """Per candidate system: decided_kept, some_kept, risk_kept (against the reference), and safe (all three)."""
    r = summary.filter(F.col(system) == reference).select(F.col("decided").alias("_d"), F.col("some_rate").alias("_s"), F.col("risk_rate").alias("_r"), F.lit(1).alias("_k"))
    c = summary.filter(F.col(system) != reference).withColumn("_k", F.lit(1)).join(r, "_k")
    gates = {"decided_kept": F.col("decided") >= F.col("_d"), "some_kept": F.col("some_rate") <= F.col("_s"), "risk_kept": F.col("risk_rate") <= F.col("_r")}
    out = c.select(system, *[g.alias(k) for k, g in gates.items()])
    return out.withColumn("safe", F.col("decided_kept") & F.col("some_kept") & F.col("risk_kept"))


def agreement(a: DataFrame, b: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(field, n, n_agree, po, pe, kappa) of two raters with the same keys."""
    both = aligned(a.select(key, *[F.col(f).alias(f"{f}_a") for f in fields]), b.select(key, *[F.col(f).alias(f"{f}_b") for f in fields]), key)
    out = None
    for f in fields:
        one = stats.kappa(both, f"{f}_a", f"{f}_b").select(F.lit(f).alias("field"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def blind_package(rows: DataFrame, id_: str, system: str, seed: str, shown: list[str]) -> DataFrame:
    """(sample, id, system, shown...): rows in hash order of the seed get A0001, A0002, ...; raters get the sample and what is shown,
    the key keeps id and system. A package is for readers, so one task numbers it."""
    order = seeded(seed, F.concat_ws("\0", id_, system))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order))
    return rows.select(F.format_string("A%04d", number).alias("sample"), id_, system, *shown)


def judged_summary(scores: DataFrame, score: str, f1: str) -> DataFrame:
    """One row: n, n_scored, n_errors, mean (of valid scores), right_rate (2 of all rows: errors are not right), right_rate_valid,
    partly_rate, wrong_rate (of valid ones), f1_right, f1_wrong. Scores are 0, 1, 2 or null; others fail the query."""
    rows = violations(scores, F.col(score).isNotNull() & ~F.col(score).isin(0, 1, 2), "a score is not 0, 1, 2 or null")
    s, n = F.col(score), F.count(F.lit(1))
    valid = F.count(s)
    share = lambda v, of: F.try_divide(F.count_if(s == v), of)
    return rows.agg(n.alias("n"), valid.alias("n_scored"), (n - valid).alias("n_errors"), F.avg(s).alias("mean"), share(2, n).alias("right_rate"), share(2, valid).alias("right_rate_valid"), share(1, valid).alias("partly_rate"), share(0, valid).alias("wrong_rate"), F.avg(F.when(s == 2, F.col(f1))).alias("f1_right"), F.avg(F.when(s == 0, F.col(f1))).alias("f1_wrong"))

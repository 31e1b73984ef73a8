"""Benchmark metrics of aggregation, normalization, imputation and integration results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, once
from .quantiles import order_statistic, running_counts


def group_table(cells: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """(feature_id, mean_a, mean_b, log2_fc, cv_a, cv_b, mean_cv): log2 of mean A by mean B where both are positive."""
    x = cells.join(groups, "sample_id")
    pick = lambda g: F.when(F.col("group") == g, F.col("value"))
    cv = lambda g: F.when((F.count(pick(g)) >= 2) & (F.avg(pick(g)) > 0), F.stddev_samp(pick(g)) / F.avg(pick(g)))
    t = x.groupBy("feature_id").agg(F.avg(pick(a)).alias("mean_a"), F.avg(pick(b)).alias("mean_b"), cv(a).alias("cv_a"), cv(b).alias("cv_b"))
    fc = F.when((F.col("mean_a") > 0) & (F.col("mean_b") > 0), F.log2(F.col("mean_a") / F.col("mean_b")))
    both = F.coalesce((F.col("cv_a") + F.col("cv_b")) / 2, "cv_a", "cv_b")
    return t.withColumns({"log2_fc": fc, "mean_cv": both})


def fold_change_errors(table: DataFrame, expected: DataFrame) -> DataFrame:
    """(species, n, coverage, mae, median_error, rmse, bias, sd_error); table has species and log2_fc, expected (species, fc)."""
    e = F.col("log2_fc") - F.col("fc")
    x = table.join(expected, "species").withColumn("e", e)
    return x.groupBy("species").agg(F.count(F.lit(1)).alias("n"), (F.count("e") / F.count(F.lit(1))).alias("coverage"), F.avg(F.abs("e")).alias("mae"), F.median(F.abs("e")).alias("median_error"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.avg("e").alias("bias"), F.stddev_samp("e").alias("sd_error"))


def pairwise_auc(table: DataFrame) -> DataFrame:
    """(a, b, auc) of log2_fc between each two species, folded to 0.5..1, by counting ranks."""
    x = table.where("log2_fc is not null").select("species", F.col("log2_fc").alias("x"))
    kinds = x.select("species").distinct()
    pairs = kinds.select(F.col("species").alias("a")).crossJoin(kinds.select(F.col("species").alias("b"))).where("a < b")
    long = pairs.join(x, (F.col("species") == F.col("a")) | (F.col("species") == F.col("b")))
    rank = F.rank().over(Window.partitionBy("a", "b").orderBy("x")) + (F.count(F.lit(1)).over(Window.partitionBy("a", "b", "x")) - 1) / 2
    s = long.withColumn("rank", rank).groupBy("a", "b").agg(F.sum(F.when(F.col("species") == F.col("a"), F.col("rank"))).alias("r"), F.count_if(F.col("species") == F.col("a")).alias("na"), F.count_if(F.col("species") == F.col("b")).alias("nb"))
    auc = (F.col("r") - F.col("na") * (F.col("na") + 1) / 2) / (F.col("na") * F.col("nb"))
    return s.select("a", "b", F.greatest(auc, 1 - auc).alias("auc"))


def mapping_burden(assignments: Column, df: DataFrame) -> DataFrame:
    """(n, share_multi, mean_targets, median_targets) of assignment texts split on ; , and |."""
    n = F.size(F.array_distinct(F.filter(F.transform(F.split(assignments, r"[;,|]"), F.trim), lambda x: x != "")))
    x = df.where(assignments.isNotNull()).select(n.alias("n"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("n") > 1).cast("int")).alias("share_multi"), F.avg("n").alias("mean_targets"), F.median("n").alias("median_targets"))


def de_consistency(table: DataFrame, expected: DataFrame, near: float = 0.5) -> DataFrame:
    """(sign_share, background_share, score): changed species with the expected sign, unchanged ones near 0."""
    x = table.where("log2_fc is not null").join(expected, "species")
    sign = F.avg(F.when(F.col("fc") != 0, (F.signum("log2_fc") == F.signum("fc")).cast("int")))
    calm = F.avg(F.when(F.col("fc") == 0, (F.abs("log2_fc") <= near).cast("int")))
    return x.agg(sign.alias("sign_share"), calm.alias("background_share")).withColumn("score", (F.col("sign_share") + F.col("background_share")) / 2)


def species_of(feature: Column) -> Column:
    """A species token in a feature's id."""
    upper = F.upper(feature)
    return F.when(upper.rlike("HUMAN"), "human").when(upper.rlike("YEAST"), "yeast").when(upper.rlike("ECOLI|ECOLX"), "ecoli").otherwise("unknown")


def distribution_metrics(cells: DataFrame) -> DataFrame:
    """(coverage, median_mad, iqr_cv, rle_mad): spread of sample medians and IQRs, median deviation from feature medians."""
    w = Window.partitionBy("feature_id")
    x = cells.withColumn("rle", F.col("value") - F.median("value").over(w))
    s = x.groupBy("sample_id").agg(F.median("value").alias("m"), (F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))).alias("iqr"), F.count("value").alias("n"), F.median("rle").alias("rm"), F.median(F.abs("rle")).alias("ra"))
    total = s.agg(F.median("m").alias("mm"))
    out = s.join(F.broadcast(total)).agg((F.median(F.abs(F.col("m") - F.col("mm"))) * 1.4826).alias("median_mad"), (F.stddev_samp("iqr") / F.avg("iqr")).alias("iqr_cv"), F.median(F.when(F.col("n") >= 5, F.col("ra"))).alias("rle_mad"))
    return cells.agg((F.count("value") / F.count(F.lit(1))).alias("coverage")).join(F.broadcast(out))


def wasserstein(cells: DataFrame, a: str, b: str, points: int = 200) -> DataFrame:
    """(distance) between the values of two samples, as the mean gap of aligned quantiles."""
    grid = F.array(*(F.lit((i + 0.5) / points) for i in range(points)))
    q = lambda s: cells.where(F.col("sample_id") == s).agg(F.percentile("value", grid).alias(f"q{s == a:d}"))
    gap = F.aggregate(F.zip_with("q1", "q0", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / points
    return q(a).join(F.broadcast(q(b))).select(gap.alias("distance"))


def group_metrics(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(within_sd, eta2): medians over features of the within-group deviation and the between-group share of squares."""
    x = cells.where("value is not null").join(groups, "sample_id")
    part = x.groupBy("feature_id", "group").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.var_pop("value").alias("v")).where("n >= 2")
    sd = part.agg(F.median("sd").alias("within_sd"))
    w = Window.partitionBy("feature_id")
    grand = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    f = part.withColumn("b", F.col("n") * (F.col("m") - grand) ** 2).groupBy("feature_id").agg(F.sum("b").alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    eta = f.where("n >= 4 and k >= 2").agg(F.median(F.try_divide("b", F.col("b") + F.col("w"))).alias("eta2"))
    return sd.join(F.broadcast(eta))


def reconstruction(pairs: DataFrame) -> DataFrame:
    """(n, coverage, mae, rmse, nrmse, median_error, pearson, spearman) of (truth, imputed)."""
    pairs = once(pairs)
    e = F.col("imputed") - F.col("truth")
    rmse = F.sqrt(F.avg(e**2))
    both = pairs.where("truth is not null and imputed is not null").select("truth", "imputed")
    rho = ranked(materialize(ranked(both, "truth", "a")), "imputed", "b").agg(F.corr("a", "b").alias("spearman"))
    out = pairs.agg(F.count("truth").alias("n"), (F.count("imputed") / F.count("truth")).alias("coverage"), F.avg(F.abs(e)).alias("mae"), rmse.alias("rmse"), (rmse / F.stddev_samp("truth")).alias("nrmse"), F.median(F.abs(e)).alias("median_error"), F.corr("truth", "imputed").alias("pearson"))
    return out.join(F.broadcast(rho))


def within_group_cv(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(cv): median over groups and features of the CV."""
    x = cells.join(groups, "sample_id").groupBy("group", "feature_id").agg(F.count("value").alias("n"), (F.stddev_samp("value") / F.when(F.avg("value") != 0, F.avg("value"))).alias("cv"))
    return x.where("n >= 2").agg(F.median(F.abs("cv")).alias("cv"))


def contrasts(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(feature_id, a, b, n_a, n_b, log2_fc): mean of a less that of b on a log scale, for each two groups a < b."""
    m = cells.where("value is not null").join(groups, "sample_id").groupBy("feature_id", "group").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    x, y = (m.select("feature_id", F.col("group").alias(g), F.col("m").alias(f"m{g}"), F.col("n").alias(f"n_{g}")) for g in "ab")
    return x.join(y, "feature_id").where("a < b").select("feature_id", "a", "b", "n_a", "n_b", (F.col("ma") - F.col("mb")).alias("log2_fc"))


def ranked(df: DataFrame, column: str, rank: str) -> DataFrame:
    """Add the rank of a column over all rows, equal values sharing their mean; nulls have none. No task sees all rows."""
    df = once(df)  # a value computed again could differ in its last bit, and would miss its rank
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("n"))
    places = running_counts(counts, "__v").select("__v", (F.col("upto") - (F.col("n") - 1) / 2).alias(rank))
    return df.join(places, df[column] == F.col("__v"), "left").drop("__v")


def _by_score(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """(s, n1, n0, above1, above0): rows of either label at each score, and above it. Both sides of the join have the same scores."""
    counts = materialize(df.where(score.isNotNull()).groupBy((-score).alias("s")).agg(F.count_if(label).alias("n1"), F.count_if(~label).alias("n0")))
    one = running_counts(counts.select("s", "n1", "n0"), "s", "n1").withColumnRenamed("upto", "above1")
    two = running_counts(counts.select("s", "n0"), "s", "n0").select("s", F.col("upto").alias("above0"))
    return one.join(two, "s").select("s", "n1", "n0", (F.col("above1") - F.col("n1")).alias("above1"), (F.col("above0") - F.col("n0")).alias("above0"))


def auc(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """(auc): the chance that a row of the label has a larger score than one without; null if one kind is missing."""
    x = _by_score(df, label, score)
    won = F.sum(F.col("n0") * (F.col("above1") + F.col("n1") / 2))
    return x.agg(F.try_divide(won, F.sum("n1") * F.sum("n0")).alias("auc"))


def partial_auc(df: DataFrame, label: Column, score: Column, max_fpr: float) -> DataFrame:
    """(pauc): the area up to a false positive rate, scaled so that chance has 0.5 and the best 1."""
    x = _by_score(df, label, score)
    total = x.agg(F.sum("n1").alias("all1"), F.sum("n0").alias("all0"))
    x = x.join(F.broadcast(total)).where("all1 > 0 and all0 > 0").withColumns({"x0": F.col("above0") / F.col("all0"), "x1": (F.col("above0") + F.col("n0")) / F.col("all0"), "y0": F.col("above1") / F.col("all1"), "y1": (F.col("above1") + F.col("n1")) / F.col("all1")}).where(F.col("x0") < max_fpr)
    end = F.least("x1", F.lit(max_fpr))
    height = F.col("y0") + F.when(F.col("x1") > F.col("x0"), (F.col("y1") - F.col("y0")) * (end - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(F.lit(0.0))
    low = max_fpr * max_fpr / 2
    return x.agg((0.5 * (1 + (F.sum((end - F.col("x0")) * (F.col("y0") + height) / 2) - low) / (max_fpr - low))).alias("pauc"))


def ratio_metrics(table: DataFrame, expected: DataFrame, background: str) -> DataFrame:
    """(n, mae, rmse, bias, pairwise_auc, changed_auc) of (species, log2_fc) on a log scale, against expected (species, fc).

    changed_auc: how well the distance from the background's expected change tells other species from the background.
    """
    x = once(table.join(expected, "species").where("log2_fc is not null").withColumn("e", F.col("log2_fc") - F.col("fc")))
    errors = x.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.avg("e").alias("bias"))
    pairwise = pairwise_auc(x).agg(F.avg("auc").alias("pairwise_auc"))
    base = expected.where(F.col("species") == background).select(F.col("fc").alias("base"))
    far = x.join(F.broadcast(base))
    changed = auc(far, F.col("species") != background, F.abs(F.col("log2_fc") - F.col("base"))).withColumnRenamed("auc", "changed_auc")
    return errors.join(F.broadcast(pairwise)).join(F.broadcast(changed))


def guess_groups(samples: DataFrame) -> DataFrame:
    """(sample_id, group) by a token that several ids share: of those that start with S or "group", the most common.

    Ids are cut at - and _; ids without the token are UNKNOWN. Empty if there is no such token, or if all ids have it.
    """
    tokens = F.filter(F.split(F.replace("sample_id", F.lit("-"), F.lit("_")), "_"), lambda t: t != "")
    x = samples.select("sample_id", tokens.alias("tokens"))
    each = x.select(F.explode("tokens").alias("token")).where((F.length("token") >= 2) & (F.col("token").startswith("S") | F.lower("token").startswith("group")))
    best = each.groupBy("token").count().where("count >= 2").orderBy(F.desc("count"), "token").limit(1).select("token")
    marked = x.join(F.broadcast(best)).withColumn("hit", F.array_contains("tokens", F.col("token")))
    some = marked.agg(F.count_if("hit").alias("in"), F.count_if(~F.col("hit")).alias("out"))
    return marked.join(F.broadcast(some)).where("in >= 2 and out >= 1").select("sample_id", F.when(F.col("hit"), F.col("token")).otherwise("UNKNOWN").alias("group"))


def nmi(pairs: DataFrame) -> DataFrame:
    """(nmi) of two labellings (a, b): shared information by the mean of both entropies; 1 if neither varies."""
    cell = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.count(F.lit(1)).alias("t"))
    part = lambda c: cell.groupBy(c).agg(F.sum("n").alias("n"))
    entropy = lambda df, name: df.join(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))).alias(name))
    x = entropy(part("a"), "ha").join(F.broadcast(entropy(part("b"), "hb"))).join(F.broadcast(entropy(cell, "hab")))
    mean = (F.col("ha") + F.col("hb")) / 2
    return x.select(F.when(mean < 1e-12, 1.0).otherwise((F.col("ha") + F.col("hb") - F.col("hab")) / F.when(mean >= 1e-12, mean)).alias("nmi"))


def topk_agreement(a: DataFrame, b: DataFrame, k: int = 100) -> DataFrame:
    """(r, jaccard, f1, sign_share, pauc_01, pauc_05, pauc_10) of two tables (feature_id, log2_fc).

    r over all features that both have; the others compare the k largest changes of each, at most all but one of the shared.
    The partial areas ask how well the second's changes find the k largest of the first.
    """
    x = a.where("log2_fc is not null").select("feature_id", F.col("log2_fc").alias("x")).join(b.where("log2_fc is not null").select("feature_id", F.col("log2_fc").alias("y")), "feature_id")
    x = materialize(x)
    k = max(1, min(k, x.count() - 1))
    top = lambda c: x.orderBy(F.desc(F.abs(c)), "feature_id").limit(k).select("feature_id", F.lit(1).alias(f"in_{c}"))
    x = x.join(top("x"), "feature_id", "left").join(top("y"), "feature_id", "left")
    x = materialize(x)
    both, any_ = F.count_if((F.col("in_x") == 1) & (F.col("in_y") == 1)), F.count_if((F.col("in_x") == 1) | (F.col("in_y") == 1))
    sign = F.avg(F.when(F.col("in_x") == 1, (F.signum("x") == F.signum("y")).cast("int")))
    out = x.agg(F.corr("x", "y").alias("r"), F.try_divide(both, any_).alias("jaccard"), (both / k).alias("f1"), sign.alias("sign_share"))
    for name, most in (("pauc_01", 0.01), ("pauc_05", 0.05), ("pauc_10", 0.1)):
        out = out.join(F.broadcast(partial_auc(x, F.coalesce(F.col("in_x") == 1, F.lit(False)), F.abs("y"), most).withColumnRenamed("pauc", name)))
    return out


def method_scores(long: DataFrame) -> DataFrame:
    """(block, method, score) from (block, method, metric, value, higher_is_better): mean of min-max scores; constants score 1."""
    w = Window.partitionBy("block", "metric")
    span = F.max("value").over(w) - F.min("value").over(w)
    up = (F.col("value") - F.min("value").over(w)) / F.when(span != 0, span)
    s = F.when(span == 0, 1.0).otherwise(F.when(F.col("higher_is_better"), up).otherwise(1 - up))
    return long.withColumn("s", F.when(F.col("value").isNotNull(), s)).groupBy("block", "method").agg(F.avg("s").alias("score"))


def holdout(cells: DataFrame, share: float, seed: int = 42, *, state: int | None = None, least: int = 0, most: int | None = None) -> DataFrame:
    """Cells with a column `held`: an exact number of the observed cells, dealt to states by their shares.

    The number is `share` of the observed cells (of those of `state`, if given), at least `least` and at most `most`. A state's
    part is rounded by largest remainders. In each state the cells of the least hash of ids and seed are held, found by counts
    of ranges; only cells that share the last hash are told apart by their ids. Cells are computed once for all of these passes.
    """
    key = F.pmod(F.xxhash64("sample_id", "feature_id", F.lit(seed)), F.lit(1 << 50))
    x = once(cells).withColumn("__hash", key)
    mine = x.where(F.col("value").isNotNull() & (F.lit(True) if state is None else F.col("mask") == state))
    counts = {r["mask"]: r["n"] for r in mine.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a state
    total = sum(counts.values())
    goal = min(max(least, int(share * total)), total if most is None else most, total)
    part = {m: goal * n // max(total, 1) for m, n in counts.items()}
    for m in sorted(counts, key=lambda m: (-(goal * counts[m] % max(total, 1)), m))[: goal - sum(part.values())]:
        part[m] += 1
    held, edge = F.lit(False), None
    observed = F.col("value").isNotNull()
    for m, n in part.items():
        if not n:
            continue
        own = mine.where(F.col("mask") == m)
        last = order_statistic(own, "__hash", n - 1)
        below = own.where(F.col("__hash") < last).count()
        ties = own.where(F.col("__hash") == last).orderBy("sample_id", "feature_id").limit(n - below).select("sample_id", "feature_id", F.lit(True).alias("__edge"))
        held = held | (observed & (F.col("mask") == m) & (F.col("__hash") < last))
        edge = ties if edge is None else edge.unionByName(ties)
    if edge is None:
        return x.drop("__hash").withColumn("held", F.lit(False))
    return x.join(edge, ["sample_id", "feature_id"], "left").withColumn("held", held | F.coalesce("__edge", F.lit(False))).select(*cells.columns, "held")


def state_profile(held: DataFrame) -> DataFrame:
    """(mask, n_observed, n_held, share) of a hold-out."""
    x = held.where("value is not null").groupBy("mask").agg(F.count(F.lit(1)).alias("n_observed"), F.count_if("held").alias("n_held"))
    return x.withColumn("share", F.col("n_held") / F.col("n_observed"))


def marker_scores(cells: DataFrame, labels: DataFrame, k: int = 25) -> DataFrame:
    """(label, feature_id, score, place): a cluster's mean less that of all other samples, the k largest."""
    x = cells.where("value is not null").join(labels, "sample_id").groupBy("label", "feature_id").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    w = Window.partitionBy("feature_id")
    rest = F.try_divide(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n"))
    x = x.withColumn("score", F.col("s") / F.col("n") - rest).where("score is not null")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "feature_id"))
    return x.withColumn("place", place).where(F.col("place") <= k).select("label", "feature_id", "score", "place")

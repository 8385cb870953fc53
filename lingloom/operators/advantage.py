"""Rewards to advantages, and the statistics of training and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingloom.session import materialize


def mean_of(arr: Column) -> Column:
    """Mean of an array of numbers; 0 if empty."""
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)).otherwise(F.lit(0.0))


FEW_GROUPS = 100_000


def per_group(df: DataFrame) -> DataFrame:
    """A table of one row a group, broadcast if there are few groups; then rows are not moved, however many one group has.

    With more groups it is shuffled: a group then holds few of all rows, and the
    adaptive skew join splits one that does not.
    """
    return F.broadcast(df) if df.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else df


def group_advantage(df: DataFrame, group: list[str], advantages: str = "advantages", coef: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """Each row's tokens shifted by coef times the z-score of its mean within its group.

    Population deviation; a group of one has z = 0. The input is computed and
    written once, the group's moments come from one aggregation of it and are
    joined back, so that rows are not sorted by group.
    """
    rows = materialize(df.withColumn("_s", mean_of(F.col(advantages))))
    named = [F.col(g).alias(f"_{g}_key") for g in group]
    found = materialize(rows.groupBy(*named).agg(F.avg("_s").alias("_m"), F.stddev_pop("_s").alias("_d")))
    on = None
    for g in group:
        same = F.col(g).eqNullSafe(F.col(f"_{g}_key"))
        on = same if on is None else on & same
    z = (F.col("_s") - F.col("_m")) / (F.col("_d") + F.lit(eps))
    joined = rows.join(per_group(found), on).select(*df.columns, z.alias("group_z"))
    return joined.withColumn(advantages, F.transform(advantages, lambda v: v + F.col("group_z") * coef))


def batch_moments(df: DataFrame, batch: str, advantages: str = "advantages") -> DataFrame:
    """(batch, mean, std, tokens) over all tokens of a batch.

    Rows give their number of tokens, their mean and their squares about it, and
    these are combined, so there is no difference of large squares.
    """
    n = F.size(advantages)
    mean = mean_of(F.col(advantages))
    rows = df.select(F.col(batch), n.alias("_n"), mean.alias("_mean"), F.aggregate(F.col(advantages), F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)).alias("_sq")).where("_n > 0")
    total = F.sum("_n")
    # sum of squares = within rows + between rows; the latter by the population variance of row means weighed by tokens
    middle = rows.groupBy(batch).agg((F.sum(F.col("_n") * F.col("_mean")) / total).alias("mean"), F.sum("_sq").alias("_within"), total.alias("tokens"))
    between = rows.join(per_group(middle.select(F.col(batch).alias("_b"), F.col("mean").alias("_all"))), F.col(batch).eqNullSafe(F.col("_b")))
    spread = between.groupBy(batch).agg(F.sum(F.col("_n") * (F.col("_mean") - F.col("_all")) * (F.col("_mean") - F.col("_all"))).alias("_between"))
    both = middle.join(spread.withColumnRenamed(batch, "_b2"), F.col(batch).eqNullSafe(F.col("_b2")))
    return both.select(batch, "mean", F.sqrt((F.col("_within") + F.col("_between")) / F.col("tokens")).alias("std"), F.col("tokens").cast("long").alias("tokens"))


def batch_advantage(df: DataFrame, batch: str, advantages: str = "advantages", eps: float = 1e-8) -> DataFrame:
    """All tokens of a batch normalised by their mean and population deviation. ``batch_moments`` of input and result are the statistics before and after."""
    rows = materialize(df)
    found = materialize(batch_moments(rows, batch, advantages)).select(F.col(batch).alias("_b"), F.col("mean").alias("_mean"), F.col("std").alias("_d"))
    joined = rows.join(per_group(found), F.col(batch).eqNullSafe(F.col("_b")), "left")
    return joined.withColumn(advantages, F.transform(advantages, lambda v: (v - F.col("_mean")) / (F.col("_d") + eps))).select(*df.columns)


def moments(df: DataFrame, value: Column, keys: list[str] | None = None) -> DataFrame:
    """Population mean and deviation; 0 and 0 without rows."""
    return df.groupBy(*(keys or [])).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"))


def policy_stats(df: DataFrame, losses: str = "token_loss", keys: list[str] | None = None) -> DataFrame:
    """Token-weighted means over the arrays that policy_token_loss makes."""
    total = lambda f: F.sum(F.aggregate(F.col(losses), F.lit(0.0), lambda a, x: a + x[f]))
    n = F.sum(F.size(losses))
    return df.groupBy(*(keys or [])).agg(
        (total("entropy") / F.greatest(n, F.lit(1))).alias("entropy"), (total("loss") / F.greatest(n, F.lit(1))).alias("policy_loss"), (total("approx_kl") / F.greatest(n, F.lit(1))).alias("approx_kl"),
        (total("clipped") / F.greatest(n, F.lit(1))).alias("clip_fraction"), (total("ref_kl") / F.greatest(n, F.lit(1))).alias("kl_to_reference"), n.cast("long").alias("token_count"),
    )


def sanitize_score(score: Column, fallback: float, policy: str = "skip") -> Column:
    """A non-finite score becomes the fallback, or an error unless the policy is skip."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, F.lit(fallback) if policy == "skip" else F.raise_error(F.lit("non-finite score")).cast("double")).otherwise(score)


def skip_overflow(length: Column, most: int, score: Column) -> Column:
    """NaN where an input is longer than the scorer takes."""
    return F.when(length > most, F.lit(float("nan"))).otherwise(score)


def severity_counts(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Spans by upper-case severity, blank ones as UNKNOWN."""
    label = F.coalesce(F.nullif(F.upper(F.trim(F.col("s.severity"))), F.lit("")), F.lit("UNKNOWN"))
    return df.select(F.explode(spans).alias("s")).groupBy(label.alias("severity")).agg(F.count("*").alias("n"))


def severity_means(df: DataFrame, spans: str = "spans", labels: tuple[str, ...] = ("MINOR", "MAJOR", "CRITICAL")) -> DataFrame:
    """Mean number of spans of each of the fixed severities a rollout."""
    n = lambda s: F.avg(F.size(F.filter(F.col(spans), lambda x: F.upper(F.trim(x["severity"])) == s)))
    return df.agg(*[F.coalesce(n(s), F.lit(0.0)).alias(f"mean_{s.lower()}") for s in labels])


def eval_report(df: DataFrame, score_a: str, score_b: str, reward: str, spans: str, completion_tokens: str) -> DataFrame:
    """One row: means and deviations of scores and reward, mean span count and completion length, rows. Zeros without rows."""
    both = lambda c: [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"{c}_std")]
    return df.agg(
        *both(score_a), *both(score_b), *both(reward), F.coalesce(F.avg(F.size(spans)), F.lit(0.0)).alias("span_count_mean"),
        F.coalesce(F.avg(F.size(completion_tokens)), F.lit(0.0)).alias("completion_length_mean"), F.count("*").alias("num_rows"),
    )


def reward_stats(df: DataFrame, rewards: str = "token_rewards") -> DataFrame:
    """Over all tokens: count, share of non-zero rewards, mean, population deviation, least and greatest."""
    tokens = df.select(F.explode(rewards).alias("r"))
    return tokens.agg(
        F.count("*").alias("tokens"), (F.count_if(F.abs("r") > 0) / F.greatest(F.count("*"), F.lit(1))).alias("nonzero_ratio"),
        F.coalesce(F.avg("r"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("r"), F.lit(0.0)).alias("std"), F.min("r").alias("least"), F.max("r").alias("greatest"),
    )


def running_best(df: DataFrame, run: list[str], update: str, score: str) -> DataFrame:
    """Best finite score of each run so far, and the update that first reached it."""
    finite = F.when(~F.isnan(score) & (F.abs(score) != float("inf")), F.col(score))
    w = Window.partitionBy(*run).orderBy(update).rowsBetween(Window.unboundedPreceding, 0)
    best = df.withColumn("best_score", F.max(finite).over(w))
    first = F.when(finite == F.col("best_score"), F.col(update))
    # the first update at the present best: the least among those from the last change of the best on
    changed = best.withColumn("_new", F.when(F.lag("best_score").over(Window.partitionBy(*run).orderBy(update)).eqNullSafe(F.col("best_score")), None).otherwise(first))
    return changed.withColumn("best_update", F.last("_new", ignorenulls=True).over(w)).drop("_new")


def timing_stats(df: DataFrame, key: str, seconds: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count"), F.sum(seconds).alias("total"), F.avg(seconds).alias("avg"), F.max(seconds).alias("max"))


def length_stats(df: DataFrame, length: Column) -> DataFrame:
    """Least, greatest, and mean times 100 cut to a whole number."""
    return df.agg(F.min(length).alias("length_min"), F.max(length).alias("length_max"), F.floor(F.sum(length) * 100 / F.greatest(F.count("*"), F.lit(1))).cast("long").alias("length_avg_x100"))


def rollout_means(df: DataFrame, advantages: str = "advantages", old: str = "old_logprobs", ref: str = "ref_logprobs") -> DataFrame:
    """Mean and sum of the advantages of each rollout, and means of its log-probabilities; empty gives 0, no reference null."""
    return df.withColumn("adv_mean", mean_of(F.col(advantages))).withColumn("adv_sum", F.aggregate(F.col(advantages), F.lit(0.0), lambda a, x: a + x)).withColumn(
        "old_logprob_mean", mean_of(F.col(old))
    ).withColumn("ref_logprob_mean", F.when(F.size(ref) > 0, mean_of(F.col(ref))))


def reward_report(df: DataFrame, first: str = "score_first", first_reward: str = "reward_first", second: str = "score_second", token_rewards: str = "token_rewards", spans: str = "spans") -> DataFrame:
    """The twelve reward statistics of a batch of rollouts in one row; zeros without rows.

    One pass: each rollout gives its token sums, which are combined, so that
    tokens are not exploded. The deviation of tokens comes from the squares about
    each rollout's mean and those of the means.
    """
    both = lambda c, n: [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{n}_mean"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"{n}_std")]
    n = lambda s: F.coalesce(F.avg(F.size(F.filter(F.col(spans), lambda x: F.upper(F.trim(x["severity"])) == s))), F.lit(0.0)).alias(f"span_{s.lower()}_mean")
    tokens = F.col(token_rewards)
    m = mean_of(tokens)
    rows = df.withColumn("_n", F.greatest(F.size(tokens), F.lit(0))).withColumn("_m", m).withColumn("_sq", F.aggregate(tokens, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))).withColumn(
        "_live", F.size(F.filter(tokens, lambda x: F.abs(x) > 0))
    )
    total = F.greatest(F.sum("_n"), F.lit(1))
    mean = F.coalesce(F.sum(F.col("_n") * F.col("_m")) / total, F.lit(0.0))
    out = rows.agg(
        *both(first, "first_score"), *both(first_reward, "first_reward"), *both(second, "second_score"), mean.alias("token_rewards_mean"), total.alias("_total"), F.coalesce(F.sum("_sq"), F.lit(0.0)).alias("_within"),
        F.coalesce(F.sum(F.col("_n") * F.col("_m") * F.col("_m")), F.lit(0.0)).alias("_means"), F.coalesce(F.sum("_live") / total, F.lit(0.0)).alias("token_rewards_non_zero_ratio"), *[n(s) for s in ("MINOR", "MAJOR", "CRITICAL")],
    )
    spread = F.sqrt(F.greatest((F.col("_within") + F.col("_means")) / F.col("_total") - F.col("token_rewards_mean") * F.col("token_rewards_mean"), F.lit(0.0)))
    names = ["first_score_mean", "first_score_std", "first_reward_mean", "first_reward_std", "second_score_mean", "second_score_std", "token_rewards_mean"]
    return out.select(*names, spread.alias("token_rewards_std"), "token_rewards_non_zero_ratio", "span_minor_mean", "span_major_mean", "span_critical_mean")

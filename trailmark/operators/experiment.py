"""Experiment assignment, summaries and test statistics.

Groups are pure functions of the user id, so no assignment table is joined. Statistics are column
arithmetic on one row per segment; an ``arms`` frame has, per segment, the columns
``n_control, x_control, n_treatment, x_treatment`` (users and converted users).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import (
    all_rows,
    half_up,
    labelled,
    long,
    nonzero,
    one_row,
    ratio,
    sum_counts,
)
from trailmark.functions.stats import CHI2_95_DF1, Z95, p_from_chi2_df1, p_from_z, z_quantile
from trailmark.operators.recommend import item_cf_recommend

PRE = ("2024-01-08", "2024-01-21")
POST = ("2024-01-22", "2024-01-30")
SALT = "ab_test_v1"


# --- assignment -----------------------------------------------------------------------------------


def parity_group(user: str | Column = "user_id") -> Column:
    user = F.col(user) if isinstance(user, str) else user
    return labelled((F.pmod(user, F.lit(2)) == 0, "control"), otherwise="treatment")


def hash_group(user: str | Column = "user_id", salt: str = SALT) -> Column:
    """Parity of md5("<user>_<salt>"); the last hex digit decides, so no big number is needed."""
    user = F.col(user) if isinstance(user, str) else user
    digest = F.md5(F.concat(user.cast("string"), F.lit(f"_{salt}")))
    last = F.conv(F.substring(digest, 32, 1), 16, 10).cast("long")
    return labelled((last % 2 == 0, "control"), otherwise="treatment")


def assign_parity(users: DataFrame) -> DataFrame:
    return users.select("user_id").distinct().select(
        "user_id",
        parity_group().alias("group_label"),
        F.pmod("user_id", F.lit(2)).alias("group_id"),
    )


def assign_hash(users: DataFrame, salt: str = SALT) -> DataFrame:
    return users.select("user_id").distinct().select("user_id", hash_group(salt=salt).alias("group_label"))


# --- summaries --------------------------------------------------------------------------------------


def _between(period) -> Column:
    return F.col("date").between(*[F.lit(d).cast("date") for d in period])


def _user_period(ud: DataFrame, period) -> DataFrame:
    """Per user inside a period: actions, counts and conversion (NULL without views)."""
    return (
        ud.filter(_between(period))
        .groupBy("user_id")
        .agg(F.sum("total_actions").alias("total_actions"), *sum_counts())
        .withColumn("conversion_rate", ratio("buy_count", "pv_count"))
    )


def ab_period_summary(ud: DataFrame, period=PRE, group: Column | None = None) -> DataFrame:
    """Per group: users, mean actions/views/purchases, conversion moments, pooled conversion."""
    group = parity_group() if group is None else group
    rate = F.col("conversion_rate")
    return (
        _user_period(ud, period)
        .groupBy(group.alias("group_label"))
        .agg(
            F.count("*").alias("sample_size"),
            half_up(F.avg("total_actions"), 2).alias("avg_actions"),
            half_up(F.avg("pv_count"), 2).alias("avg_pv"),
            half_up(F.avg("buy_count"), 2).alias("avg_buy"),
            half_up(F.avg(rate), 4).alias("avg_conversion_rate"),
            half_up(F.stddev_pop(rate), 4).alias("std_conversion_rate"),
            F.min(rate).alias("min_conversion_rate"),
            F.max(rate).alias("max_conversion_rate"),
            F.sum("buy_count").alias("total_buy"),
            F.sum("pv_count").alias("total_pv"),
        )
        .withColumn("overall_conversion_rate", ratio("total_buy", "total_pv"))
    )


def ab_user_diff(
    ud: DataFrame, pre=PRE, post=POST, group: Column | None = None, top: int | None = 20
) -> DataFrame:
    """Per user conversion before and after, and the difference; one aggregate over both periods.

    The report shows the first ``top`` by group and user, None gives all.
    """
    group = parity_group() if group is None else group
    sums = []
    for name, period in (("pre", pre), ("post", post)):
        inside = _between(period)
        for b in ("buy", "pv"):
            sums.append(
                F.sum(F.when(inside, F.col(f"{b}_count")).otherwise(0)).alias(f"{name}_{b}_count")
            )
    per_user = ud.groupBy("user_id").agg(*sums)

    def rate(name):
        return F.coalesce(ratio(f"{name}_buy_count", f"{name}_pv_count"), F.lit(0.0))

    out = per_user.select(
        "user_id",
        group.alias("group_label"),
        rate("pre").alias("pre_conversion_rate"),
        "pre_buy_count",
        "pre_pv_count",
        rate("post").alias("post_conversion_rate"),
        "post_buy_count",
        "post_pv_count",
        half_up(rate("post") - rate("pre"), 4).alias("conversion_diff"),
    )
    return out if top is None else out.orderBy("group_label", "user_id").limit(top)


def ab_group_stats(ud: DataFrame, period=POST, group: Column | None = None) -> DataFrame:
    """Inputs of a t-test: users with views, mean, sample variance and deviation of conversion."""
    group = parity_group() if group is None else group
    rate = F.col("conversion_rate")
    return (
        _user_period(ud, period)
        .filter(F.col("pv_count") > 0)
        .groupBy(group.alias("group_label"))
        .agg(
            F.count("*").alias("n"),
            half_up(F.avg(rate), 4).alias("mean"),
            half_up(F.var_samp(rate), 6).alias("variance"),
            half_up(F.stddev_samp(rate), 6).alias("std_dev"),
            half_up(F.min(rate), 4).alias("min_rate"),
            half_up(F.max(rate), 4).alias("max_rate"),
        )
    )


def ab_conversion(ud: DataFrame, group: Column | None = None) -> DataFrame:
    """Users and buyers per group."""
    group = parity_group() if group is None else group
    per_user = ud.groupBy("user_id").agg(F.sum("buy_count").alias("buys"))
    return (
        per_user.groupBy(group.alias("group_label"))
        .agg(F.count("*").alias("users"), F.count_if(F.col("buys") > 0).alias("buyers"))
        .withColumn("conversion_rate", ratio("buyers", "users", 6))
    )


def daily_arms(ud: DataFrame, group: Column | None = None) -> DataFrame:
    """Arms per date: active users and buyers of each group that day."""
    g = parity_group() if group is None else group
    bought = F.col("buy_count") > 0
    return ud.groupBy("date").agg(
        F.count_if(g == "control").alias("n_control"),
        F.count_if((g == "control") & bought).alias("x_control"),
        F.count_if(g == "treatment").alias("n_treatment"),
        F.count_if((g == "treatment") & bought).alias("x_treatment"),
    )


def segment_arms(behavior: DataFrame, segments: DataFrame, by: dict[str, str], group: Column | None = None) -> DataFrame:
    """Arms of everyone and of every slice: (dimension, slice) with active users and buyers of each group.

    ``by`` maps dimension names to columns of ``behavior`` or of ``segments``, a row per user. A user is in
    each slice the user is active in, and a buyer there if an event of the slice is a purchase. Events are
    grouped once to a row per user and combination of slices, and only those rows meet the grouping sets.
    """
    g = parity_group() if group is None else group
    columns = list(by.values())
    bought = (F.col("behavior_type") == "buy").cast("int")
    own = [c for c in columns if c in behavior.columns]
    units = behavior.groupBy("user_id", *own).agg(F.max(bought).alias("bought")).join(segments, "user_id")
    units = units.select("user_id", "bought", *[F.col(c).cast("string").alias(c) for c in columns])
    user = F.col("user_id")
    sets = [[user], *[[user, F.col(c)] for c in columns]]
    of = F.lit("all")
    for name, c in by.items():
        of = F.when(F.grouping(c) == 0, F.lit(name)).otherwise(of)
    per_user = units.groupingSets(sets, user, *[F.col(c) for c in columns]).agg(
        F.max("bought").alias("bought"), of.alias("dimension")
    )
    # a slice may be a missing value of its dimension; no set has two dimensions
    slice_ = F.when(F.col("dimension") == "all", F.lit("all")).otherwise(F.coalesce(*columns))
    per_user = per_user.select("user_id", "bought", "dimension", slice_.alias("slice"))
    return per_user.groupBy("dimension", "slice").agg(
        F.count_if(g == "control").alias("n_control"),
        F.count_if((g == "control") & (F.col("bought") == 1)).alias("x_control"),
        F.count_if(g == "treatment").alias("n_treatment"),
        F.count_if((g == "treatment") & (F.col("bought") == 1)).alias("x_treatment"),
    )


# --- tests -------------------------------------------------------------------------------------------


def adjusted(tested: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg over all rows of ``tested``, a frame of one row per slice: ``p_adjusted`` is the least
    p x rows / rank of this row and of those with larger p; ``discovery`` marks those up to ``alpha``. Rows
    without a p-value are not of the family and get null."""
    order = [F.asc_nulls_last("p_value"), *[F.asc(c) for c in by]]
    n = F.count("p_value").over(all_rows())
    ranked = tested.withColumn("_rank", F.row_number().over(all_rows().orderBy(*order)))
    ranked = ranked.withColumn("_step", F.col("p_value") * n / F.col("_rank"))
    larger = all_rows().orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    least = F.when(F.col("p_value").isNotNull(), F.least(F.min("_step").over(larger), F.lit(1.0)))
    return ranked.select(
        *tested.columns, half_up(least, 9).alias("p_adjusted"), long(half_up(least, 9) <= alpha).alias("discovery")
    )


def srm_check(arms: DataFrame, share: float = 0.5, by=(), p_value: bool = True) -> DataFrame:
    """Sample-ratio mismatch: chi-square of the observed split against the planned one."""
    total = (F.col("n_control") + F.col("n_treatment")).cast("double")

    def part(n, expected):
        return (F.col(n) - expected) * (F.col(n) - expected) / nonzero(expected)

    chi2 = part("n_control", total * share) + part("n_treatment", total * (1 - share))
    out = arms.select(
        *by,
        "n_control",
        "n_treatment",
        half_up(chi2, 6).alias("chi2"),
        long(chi2 <= CHI2_95_DF1).alias("balanced"),
        chi2.alias("_chi2"),
    )
    if p_value:
        out = out.withColumn("p_value", p_from_chi2_df1(F.col("_chi2")))
    return out.drop("_chi2")


def two_proportion_z(arms: DataFrame, by=(), pooled: bool = True, p_value: bool = True) -> DataFrame:
    """Treatment against control: z, difference with its 95 % interval, relative lift in percent.

    The interval uses the pooled error like the test does; ``pooled=False`` uses the unpooled one.
    """
    nc, nt = F.col("n_control"), F.col("n_treatment")
    pc, pt = ratio("x_control", nc, None), ratio("x_treatment", nt, None)
    p = (F.col("x_control") + F.col("x_treatment")) / nonzero(nc + nt)
    one = F.lit(1.0)
    se = F.sqrt(p * (1 - p) * (one / nonzero(nc) + one / nonzero(nt)))
    se_ci = se if pooled else F.sqrt(pc * (1 - pc) / nonzero(nc) + pt * (1 - pt) / nonzero(nt))
    z = F.when(se > 0, (pt - pc) / nonzero(se)).otherwise(0.0)
    out = arms.select(
        *by,
        half_up(pc, 6).alias("control_rate"),
        half_up(pt, 6).alias("treatment_rate"),
        half_up(pt - pc, 6).alias("diff"),
        half_up(se, 6).alias("std_error"),
        half_up(z, 6).alias("z"),
        half_up(pt - pc - Z95 * se_ci, 6).alias("ci_low"),
        half_up(pt - pc + Z95 * se_ci, 6).alias("ci_high"),
        half_up((pt - pc) * 100 / nonzero(pc), 4).alias("lift_pct"),
        z.alias("_z"),
    )
    if p_value:
        out = out.withColumn("p_value", p_from_z(F.col("_z"))).withColumn(
            "significant", long(F.col("p_value") < 0.05)
        )
    return out.drop("_z")


def chi2_contingency(arms: DataFrame, by=(), yates: bool = True, p_value: bool = True) -> DataFrame:
    """2 x 2 chi-square of group and purchase with expected buyers; Yates correction by default."""
    n = (F.col("n_control") + F.col("n_treatment")).cast("double")
    buyers = F.col("x_control") + F.col("x_treatment")
    e_control = F.col("n_control") * buyers / nonzero(n)
    e_treatment = F.col("n_treatment") * buyers / nonzero(n)
    gap = F.abs(F.col("x_control") - e_control)
    # all four cells are off by the same amount
    if yates:
        gap = F.greatest(F.lit(0.0), gap - F.least(F.lit(0.5), gap))
    rest_control = F.col("n_control") - e_control
    rest_treatment = F.col("n_treatment") - e_treatment
    one = F.lit(1.0)
    chi2 = (gap * gap) * (
        one / nonzero(e_control)
        + one / nonzero(e_treatment)
        + one / nonzero(rest_control)
        + one / nonzero(rest_treatment)
    )
    out = arms.select(
        *by,
        half_up(e_control, 6).alias("expected_control"),
        half_up(e_treatment, 6).alias("expected_treatment"),
        half_up(chi2, 6).alias("chi2"),
        long(chi2 > CHI2_95_DF1).alias("dependent"),
        chi2.alias("_chi2"),
    )
    if p_value:
        out = out.withColumn("p_value", p_from_chi2_df1(F.col("_chi2")))
    return out.drop("_chi2")


def required_sample_size(
    arms: DataFrame, by=(), alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """Users per arm needed to see the observed difference; infinite (NULL) if there is none."""
    pc, pt = ratio("x_control", "n_control", None), ratio("x_treatment", "n_treatment", None)
    z = z_quantile(1 - alpha / 2) + z_quantile(power)
    gap = F.abs(pc - pt)
    root = F.lit(z) * F.sqrt(pc * (1 - pc) + pt * (1 - pt)) / nonzero(gap)
    need = root * root
    return arms.select(
        *by,
        half_up(need, 4).alias("required_per_arm"),
        F.coalesce(
            long(F.least("n_control", "n_treatment") >= need), F.lit(0).cast("long")
        ).alias("sufficient"),
    )


def proportion_ci(groups: DataFrame, by=("group_label",), alpha: float = 0.05) -> DataFrame:
    """Wald interval per group; ``groups`` has users and buyers."""
    p = ratio("buyers", "users", None)
    half = F.lit(z_quantile(1 - alpha / 2)) * F.sqrt(p * (1 - p) / nonzero("users"))
    return groups.select(
        *by,
        "users",
        "buyers",
        half_up(p, 6).alias("rate"),
        half_up(p - half, 6).alias("ci_low"),
        half_up(p + half, 6).alias("ci_high"),
    )


def cohens_h(arms: DataFrame, by=()) -> DataFrame:
    """Effect size 2 (asin sqrt p_treatment - asin sqrt p_control)."""
    pc, pt = ratio("x_control", "n_control", None), ratio("x_treatment", "n_treatment", None)
    return arms.select(
        *by, half_up(2 * (F.asin(F.sqrt(pt)) - F.asin(F.sqrt(pc))), 6).alias("cohens_h")
    )


def welch_t_did(user_diff: DataFrame) -> DataFrame:
    """Welch t of post conversion and the difference in differences, treatment minus control."""
    arm = {}
    for g in ("control", "treatment"):
        mine = F.col("group_label") == g
        for name, column in (("post", "post_conversion_rate"), ("diff", "conversion_diff")):
            value = F.when(mine, F.col(column))
            arm[f"m_{name}_{g}"] = F.avg(value)
            arm[f"v_{name}_{g}"] = F.var_samp(value)
        arm[f"n_{g}"] = F.count_if(mine)
    one = user_diff.agg(*[v.alias(k) for k, v in arm.items()])

    def gap(name):
        return F.col(f"m_{name}_treatment") - F.col(f"m_{name}_control")

    def part(name, g):
        return F.col(f"v_{name}_{g}") / nonzero(f"n_{g}")

    def error2(name):
        return part(name, "treatment") + part(name, "control")

    def dof(name):
        a, b = part(name, "treatment"), part(name, "control")
        return (a + b) * (a + b) / nonzero(
            a * a / nonzero(F.col("n_treatment") - 1) + b * b / nonzero(F.col("n_control") - 1)
        )

    return one.select(
        "n_control",
        "n_treatment",
        half_up(gap("post"), 6).alias("post_diff"),
        half_up(gap("post") / nonzero(F.sqrt(error2("post"))), 4).alias("t_post"),
        half_up(dof("post"), 2).alias("df_post"),
        half_up(gap("diff"), 6).alias("did"),
        half_up(gap("diff") / nonzero(F.sqrt(error2("diff"))), 4).alias("t_did"),
        half_up(dof("diff"), 2).alias("df_did"),
    )


# --- recommender holdout ----------------------------------------------------------------------------------


def recommender_lift(
    ub: DataFrame,
    split_date: str = POST[0],
    k: int = 10,
    train_users: int | None = None,
    salt: str = SALT,
    p_value: bool = True,
) -> DataFrame:
    """Hash-split holdout: item CF learned on control, conversion of both arms after the split.

    Arms are the users with a purchase before ``split_date``; converted ones buy on or after it. The
    treatment users were not really shown anything, so the lift compares two random halves; how many
    bought an item the recommender would have shown is reported next to it.
    """
    day = F.lit(split_date).cast("date")
    group = hash_group(salt=salt)
    buys = ub.filter(F.col("behavior_type") == "buy")
    before, after = buys.filter(F.col("date") < day), buys.filter(F.col("date") >= day)

    everyone = ub.groupBy("user_id").agg(
        F.count_if((F.col("behavior_type") == "buy") & (F.col("date") < day)).alias("pre"),
        F.count_if((F.col("behavior_type") == "buy") & (F.col("date") >= day)).alias("post"),
    )
    active, converted = F.col("pre") > 0, (F.col("pre") > 0) & (F.col("post") > 0)
    sides = {}
    for g in ("control", "treatment"):
        sides[f"{g}_n"] = F.count_if(group == g)
        sides[f"n_{g}"] = F.count_if((group == g) & active)
        sides[f"x_{g}"] = F.count_if((group == g) & converted)
    arms = everyone.agg(*[v.alias(name) for name, v in sides.items()])

    teachers = (
        before.filter(group == "control")
        .groupBy("user_id")
        .agg(F.count("*").alias("c"))
        .filter(F.col("c") >= 2)
    )
    if train_users is not None:
        teachers = teachers.orderBy(F.desc("c"), "user_id").limit(train_users)
    lessons = (
        before.join(teachers.select("user_id"), "user_id", "left_semi")
        .select("user_id", "item_id")
        .distinct()
    )
    history = before.filter(group == "treatment").select("user_id", "item_id").distinct()
    recs = item_cf_recommend(history, lessons, k)
    sold = after.select("user_id", "item_id", F.lit(1).alias("hit")).distinct()
    outcome = one_row(
        recs.join(sold, ["user_id", "item_id"], "left")
        .groupBy("user_id")
        .agg(F.max("hit").alias("hit"))
        .agg(F.count("*").alias("total"), F.count("hit").alias("hits"))
    )
    total = (F.col("control_n") + F.col("treatment_n")).cast("double")
    gap = F.col("control_n") - total * 0.5
    test = two_proportion_z(
        arms,
        by=["control_n", "treatment_n", "n_control", "n_treatment", "x_control", "x_treatment"],
        p_value=p_value,
    )
    return test.withColumn(
        "srm_chi2", half_up(2 * (gap * gap) / nonzero(total * 0.5), 6)
    ).select(
        "*",
        outcome("total").alias("treatment_rec_total"),
        outcome("hits").alias("treatment_rec_hits"),
    )


def daily_groups(ud: DataFrame, group: Column | None = None) -> DataFrame:
    """Users and buyers per date and group, the input of ``proportion_ci``."""
    group = parity_group() if group is None else group
    return ud.groupBy("date", group.alias("group_label")).agg(
        F.count("*").alias("users"), F.count_if(F.col("buy_count") > 0).alias("buyers")
    )

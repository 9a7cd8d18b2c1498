"""Probabilistic decisions, information planning and acceptance, as Columns over belief rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import normal_cdf

CERTAIN = 1e-15
PASS_AT, FAIL_AT = 0.9987, 0.5
#: Least floor area of a room (m2) and least clear height (m).
MIN_ROOM_AREA, MIN_CLEAR_HEIGHT = 7.0, 2.4


def probability_above(mean: Column, sd: Column, least: Column) -> Column:
    """P(X >= least); with (almost) no spread the mean decides."""
    return F.when(sd <= CERTAIN, F.when(mean >= least, 1.0).otherwise(0.0)).otherwise(normal_cdf((mean - least) / F.nullif(sd, F.lit(0.0))))


def verdict(p: Column, confidence: float) -> Column:
    if not 0.5 < confidence < 1:
        raise ValueError("confidence must lie between 0.5 and 1")
    return F.when(p >= confidence, "SATISFIED").when(1 - p >= confidence, "VIOLATED").otherwise("UNRESOLVED")


def minimum(values: DataFrame, least: float, confidence: float) -> DataFrame:
    """values (..., mu, sd) with p and verdict."""
    out = values.withColumn("p", probability_above(F.col("mu"), F.col("sd"), F.lit(float(least))))
    return out.withColumn("verdict", verdict(F.col("p"), confidence))


def difference(pairs: DataFrame, margin: float, confidence: float) -> DataFrame:
    """pairs (..., lhs, rhs, var_lhs, var_rhs, cov): P(lhs - rhs >= margin) with the joint variance."""
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("var_lhs") + F.col("var_rhs") - 2 * F.col("cov")))
    out = pairs.withColumn("sd", sd).withColumn("p", probability_above(F.col("lhs") - F.col("rhs"), F.col("sd"), F.lit(float(margin))))
    return out.withColumn("verdict", verdict(F.col("p"), confidence))


def clearance(pairs: DataFrame, confidence: float, by: list[str]) -> DataFrame:
    """pairs (..., p_violation): bounds on the probability that any pair is violated, and the verdict on having none."""
    bounds = pairs.groupBy(*by).agg(F.max("p_violation").alias("lower"), F.least(F.lit(1.0), F.sum("p_violation")).alias("upper"))
    return bounds.withColumn("verdict", F.when(F.col("upper") <= 1 - confidence, "SATISFIED").when(F.col("lower") >= confidence, "VIOLATED").otherwise("UNRESOLVED"))


def compliance(margins: DataFrame) -> DataFrame:
    """margins (..., margin, sd) with p and status."""
    p = probability_above(F.col("margin"), F.col("sd"), F.lit(0.0))
    return margins.withColumn("p", p).withColumn("status", F.when(F.col("p") >= PASS_AT, "PASS").when(F.col("p") <= FAIL_AT, "FAIL").otherwise("MARGINAL"))


def information_gain(candidates: DataFrame) -> DataFrame:
    """candidates (..., variance, noise) or also (target_variance, target_cov): gain in nats.

    Without a target 0.5 ln(s / noise); with one 0.5 ln(v / (v - c^2 / s)), s being variance + noise.
    """
    s = F.col("variance") + F.col("noise")
    if "target_variance" in candidates.columns:
        left = F.col("target_variance") - F.col("target_cov") ** 2 / s
        return candidates.withColumn("gain", 0.5 * F.log(F.col("target_variance") / left))
    return candidates.withColumn("gain", 0.5 * F.log(s / F.col("noise")))


def plan(candidates: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """candidates (..., gain, cost, risk, noise): expected free energy, best first per ``by``."""
    efe = candidates.withColumn("efe", F.col("risk") + F.col("cost") - F.col("gain"))
    return efe.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("efe", "noise", label)))


def evidence(decisions: DataFrame, planned: DataFrame, by: list[str]) -> DataFrame:
    """What to do about each decision: nothing if resolved, else the best observation if its net gain is positive."""
    best = planned.filter("rank = 1").select(*by, "label", (F.col("gain") - F.col("cost")).alias("net"))
    out = decisions.join(best, by, "left")
    return out.withColumn("disposition", F.when(F.col("verdict") != "UNRESOLVED", "RESOLVED").when(F.col("net").isNull(), "NO_CANDIDATE").when(F.col("net") > CERTAIN, "OBSERVE").otherwise("NOT_WORTH"))


def acceptance(checks: DataFrame, by: list[str]) -> DataFrame:
    """checks (..., verdict, covered): one disposition per case. A violated check rejects, then open ones request evidence."""
    n = lambda c: F.count_if(c)
    out = checks.groupBy(*by).agg(n(F.col("verdict") == "VIOLATED").alias("violated"), n(F.col("verdict") == "UNRESOLVED").alias("unresolved"), n(~F.col("covered")).alias("uncovered"))
    return out.withColumn("disposition", F.when(F.col("violated") > 0, "REJECT").when(F.col("unresolved") > 0, "REQUEST_EVIDENCE").when(F.col("uncovered") > 0, "REQUEST_EVIDENCE").otherwise("ACCEPT"))


def geometry_gate(cases: DataFrame) -> DataFrame:
    """Accepted cases with a clearance check need swept solids or a scan as geometry, or a scan receipt; else evidence."""
    enough = F.col("authority").isin("SWEPT_SOLID", "SCAN_GMM") | F.col("scan_receipt")
    return cases.withColumn("gated", F.when((F.col("disposition") == "ACCEPT") & F.col("has_clearance") & ~enough, "REQUEST_EVIDENCE").otherwise(F.col("disposition")))


def route_clearance(pairs: DataFrame, points: int = 25, diversity: float = 0.50, confidence: float = 0.80) -> DataFrame:
    """pairs (p, n_points, diversity, confidence): shortfall of the scan and what to do, by priority.

    Fixed values: 25 points, 0.50 diversity, 0.80 assignment confidence.
    """
    short = lambda c, least: F.greatest(F.lit(0.0), 1 - F.col(c) / least)
    p = F.greatest(F.lit(1e-300), F.least(F.col("p"), F.lit(1.0)))
    q = F.greatest(F.lit(1e-300), 1 - F.col("p"))
    out = pairs.withColumn("deficit", F.greatest(short("n_points", points), short("diversity", diversity), short("confidence", confidence)))
    out = out.withColumn("priority", -(p * F.log(p) + q * F.log(q)) * (1 + F.col("deficit")))
    return out.withColumn("action", F.when(F.col("deficit") > 0, "RESCAN").otherwise("EXTRACT"))


def bending(checks: DataFrame) -> DataFrame:
    """checks (fy_mpa, zx_m3, demand_nm): yielding strength in bending, with resistance factor 0.9."""
    nominal = 1e6 * F.col("fy_mpa") * F.col("zx_m3")
    return checks.withColumn("nominal_nm", nominal).withColumn("available_nm", 0.9 * nominal).withColumn("status", F.when(F.col("demand_nm") <= 0.9 * nominal, "PASS").otherwise("FAIL"))


def effort(requests: DataFrame) -> DataFrame:
    """requests (allowed, gain, cost_nats, authority, needs_authority): refuse, defer or invoke."""
    return requests.withColumn("effort", F.when(~F.col("allowed"), "REFUSE").when(F.col("needs_authority") & ~F.col("authority"), "REFUSE").when(F.col("gain") <= F.col("cost_nats"), "DEFER").otherwise("INVOKE"))


def calibrated(seen: DataFrame) -> DataFrame:
    """seen (indicated, unit, expected_unit, scale, offset): the calibrated value; another unit is an error."""
    ok = F.when(F.col("unit") == F.col("expected_unit"), F.lit(True)).otherwise(F.raise_error(F.lit("the unit differs from the calibration's")))
    return seen.withColumn("value", F.when(ok, F.col("scale") * F.col("indicated") + F.col("offset")))


def clearance_check(bounds: DataFrame) -> DataFrame:
    """bounds (lower, upper) on a violation as bounds on its absence: the check asks that nothing is violated."""
    return bounds.withColumns({"satisfied_at_least": 1 - F.col("upper"), "satisfied_at_most": 1 - F.col("lower")})


def coverage(needed: DataFrame, reached: DataFrame, by: list[str]) -> DataFrame:
    """(by, needed, covered, missing) of a plan: which needed coordinates (by, c) its observations reach (by, c)."""
    have = reached.select(*by, "c").distinct().withColumn("got", F.lit(True))
    both = needed.select(*by, "c").distinct().join(have, [*by, "c"], "left")
    return both.groupBy(*by).agg(F.count("*").alias("needed"), F.count("got").alias("covered"), F.count_if(F.col("got").isNull()).alias("missing"))


def inspectability(targets: DataFrame, planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """targets (key) as INSPECTED, PLANNED or BLIND: whether an observation of them exists, is planned, or neither."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = targets.select(key).distinct().join(flag(done, "d"), key, "left").join(flag(planned, "p"), key, "left")
    return out.select(key, F.when(F.col("d"), "INSPECTED").when(F.col("p"), "PLANNED").otherwise("BLIND").alias("state"))


def cited_budget(cited: DataFrame, budgets: DataFrame) -> DataFrame:
    """cited (digest, quantity, unit, u_c) against budgets of the same columns: whether it may be used, or what differs first."""
    b = budgets.select("digest", *(F.col(c).alias(f"b_{c}") for c in ("quantity", "unit", "u_c")))
    out = cited.join(b, "digest", "left")
    reason = F.when(F.col("b_quantity").isNull(), "NO_BUDGET").when(F.col("b_quantity") != F.col("quantity"), "QUANTITY").when(F.col("b_unit") != F.col("unit"), "UNIT").when(F.col("b_u_c") != F.col("u_c"), "UNCERTAINTY").otherwise("OBSERVE")
    return out.withColumn("outcome", reason).drop("b_quantity", "b_unit", "b_u_c")


def survey_ticks(ticks: DataFrame) -> DataFrame:
    """ticks (acquisition, x, y, sx, sy, sxy, angle) that were received, turned into the site's axes; nothing is filled in."""
    c, s = F.cos("angle"), F.sin("angle")
    got = ticks.filter("acquisition = 'received'")
    return got.withColumns({
        "site_x": c * F.col("x") - s * F.col("y"), "site_y": s * F.col("x") + c * F.col("y"),
        "site_sx": c * c * F.col("sx") - 2 * c * s * F.col("sxy") + s * s * F.col("sy"), "site_sy": s * s * F.col("sx") + 2 * c * s * F.col("sxy") + c * c * F.col("sy"),
    })


def changed_decisions(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """before, after (key, verdict, mu, sd): decisions that differ, with how belief moved; one side may lack a key."""
    side = lambda df, x: df.select(key, *(F.col(c).alias(f"{c}_{x}") for c in ("verdict", "mu", "sd")))
    both = side(before, "before").join(side(after, "after"), key, "full")
    return both.filter(~F.col("verdict_before").eqNullSafe(F.col("verdict_after"))).withColumns({"moved": F.col("mu_after") - F.col("mu_before"), "narrowed": F.col("sd_before") - F.col("sd_after")})

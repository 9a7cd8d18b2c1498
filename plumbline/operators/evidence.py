"""What evidence a decision still lacks: presentable spaces with open requests and tickets, binds, effort, reach of plans.

Documents are rows; a malformed one leaves its request open with the reason, and never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of requests, what they ask for, and the instrument that answers them.
REQUESTS = {
    "identity.space": ("IfcSpace GlobalId for this project space", "ifc-space-entity"),
    "bind.point_to_guid": ("layout point bound to an IfcGuid", "total-station-or-layout"),
    "evidence.as_built": ("ledger-bound ObserveLinearized or ObserveQuantity digest", "calibrated-observation"),
    "case.missing": ("at least one on-disk case receipt for this space", "case-receipt"),
}
#: Instruments of further codes.
INSTRUMENTS = {k: v[1] for k, v in REQUESTS.items()} | {
    "evidence.scan_gmm": "terrestrial-scan", "frame.station_setup": "total-station", "accessory.prism_height": "prism-pole", "frame.level_loop": "digital-level", "calibration.declared": "declared-calibration",
}
BIND_SCHEMA, CLAIM_SCOPE = "cse-point-bind-v1", "record-integrity-only"
#: What a bind must say, in the order in which it is checked.
BIND_TEXTS = ("point_id", "global_id", "ifc_class", "frame_id", "epoch")
#: How names begin that are given to readers and aren't ids.
DISPLAY = ("Opening-", "Door-", "Office-", "L3-", "Wall-", "Beam-")


def bind_fault(bindable: tuple[str, ...]) -> Column:
    """Why a row (schema, claim_scope, point_id, global_id, ifc_class, frame_id, epoch, sigma, sigma_unit, sigma_reason) is no bind; null
    if it is one. ``bindable``: classes that may be bound."""
    empty = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    out = F.when(~F.col("schema").eqNullSafe(BIND_SCHEMA), "unsupported bind schema").when(~F.col("claim_scope").eqNullSafe(CLAIM_SCOPE), "claim_scope")
    for c in BIND_TEXTS:
        out = out.when(empty(c), c)
    out = out.when(~F.col("ifc_class").isin(*bindable), "ifc_class is not bindable").when(F.col("global_id").contains(" ") | F.col("global_id").rlike("^(" + "|".join(DISPLAY) + ")"), "global_id is a display name")
    out = out.when(F.col("sigma").isNull() | F.isnan("sigma") | (F.col("sigma") <= 0) | (F.col("sigma") == float("inf")), "sigma")
    for c in ("sigma_unit", "sigma_reason"):
        out = out.when(empty(c), c)
    return out


def inspectability(spaces: DataFrame, receipts: DataFrame, binds: DataFrame, extra: DataFrame, bindable: tuple[str, ...]) -> DataFrame:
    """(space, inspectability, requests): ACCEPT, REJECT or REQUEST_EVIDENCE for each space, with what is still asked for.

    spaces (space, ifc_class, global_id); receipts (space, disposition, evidence_digest); binds (space, and what
    :func:`bind_fault` reads); extra (space, code, asks_for). A rejected case rejects the space whatever else is open; else any
    request, and the lack of any case, asks for evidence. ``requests`` are (code, asks_for, refused) in that order.
    """
    one = spaces.groupBy("space").agg(F.max(F.when(F.col("ifc_class") == "IfcSpace", F.nullif("global_id", F.lit("")))).alias("global_id"))
    cases = receipts.groupBy("space").agg(
        F.count("*").alias("cases"), F.max(F.coalesce(F.col("disposition").isin("REJECT", "VIOLATED"), F.lit(False))).alias("rejected"),
        F.max(F.coalesce(F.length("evidence_digest") >= 16, F.lit(False))).alias("built"),
    )
    judged = binds.withColumn("fault", bind_fault(bindable)).groupBy("space").agg(F.max(F.col("fault").isNull()).alias("bound"), F.array_join(F.array_sort(F.collect_set("fault")), "; ").alias("refused"))
    more = extra.groupBy("space").agg(F.array_sort(F.collect_set(F.struct("code", "asks_for", F.lit(None).cast("string").alias("refused")))).alias("more"))
    j = one.join(cases, "space", "left").join(judged, "space", "left").join(more, "space", "left")
    ask = lambda code, refused=None: F.struct(F.lit(code).alias("code"), F.lit(REQUESTS[code][0]).alias("asks_for"), (F.lit(None).cast("string") if refused is None else refused).alias("refused"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    asked = F.array(F.when(F.col("global_id").isNull(), ask("identity.space")), F.when(~yes("bound"), ask("bind.point_to_guid", F.nullif("refused", F.lit("")))), F.when(~yes("built"), ask("evidence.as_built")))
    kept = F.concat(F.filter(asked, lambda x: x.isNotNull()), F.coalesce("more", F.array().cast("array<struct<code:string,asks_for:string,refused:string>>")))
    j = j.withColumn("requests", kept)
    missing = (F.size("requests") == 0) & F.col("cases").isNull()
    state = F.when(yes("rejected"), "REJECT").when((F.size("requests") > 0) | missing, "REQUEST_EVIDENCE").otherwise("ACCEPT")
    return j.select("space", state.alias("inspectability"), F.when(missing, F.array(ask("case.missing"))).otherwise(F.col("requests")).alias("requests"))


def tickets(index: DataFrame) -> DataFrame:
    """(space, code, asks_for, instrument): one work order for each open request of spaces that aren't accepted."""
    known = F.create_map(*(F.lit(x) for kv in INSTRUMENTS.items() for x in kv))
    rows = index.filter("inspectability <> 'ACCEPT'").select("space", F.explode("requests").alias("r"))
    return rows.select("space", "r.code", "r.asks_for", F.coalesce(F.try_element_at(known, F.col("r.code")), F.lit("unspecified")).alias("instrument"))


def effort(requests: DataFrame, table: DataFrame) -> DataFrame:
    """requests (id, name, hole, gain, authority) against table (name, authority, allowed, cost_nats): disposition and reason.

    Unknown names, another authority, a cost that is missing, negative or not finite, and what isn't allowed are refused;
    without a named hole and a finite expected gain, or if the gain doesn't exceed the cost, the work is deferred.
    """
    t = table.select("name", F.col("authority").alias("owner"), "allowed", F.col("cost_nats").alias("cost"), F.lit(True).alias("known"))
    j = requests.join(t, "name", "left")
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (F.col(c) >= 0)
    rules = (
        ("REFUSE", F.lit("unknown name"), F.col("known").isNull()),
        ("REFUSE", F.concat(F.lit("authority is "), "owner"), F.col("owner") != F.col("authority")),
        ("REFUSE", F.lit("cost missing or not finite"), ~number("cost")),
        ("REFUSE", F.lit("not allowed"), ~F.coalesce("allowed", F.lit(False))),
        ("DEFER", F.lit("needs a named hole and a finite gain"), F.col("hole").isNull() | (F.col("hole") == "") | ~number("gain")),
        ("DEFER", F.lit("gain does not exceed cost"), F.col("gain") <= F.col("cost")),
    )
    what = why = None
    for disposition, reason, fits in rules:
        what = F.when(fits, disposition) if what is None else what.when(fits, disposition)
        why = F.when(fits, reason) if why is None else why.when(fits, reason)
    return j.select("id", what.otherwise("INVOKE").alias("disposition"), why.otherwise("gain exceeds cost").alias("reason"))


def _reached(gain: Column, prior: Column, rtol: float) -> Column:
    return F.coalesce(gain, F.lit(0.0)) > rtol / prior


def informed(prior: DataFrame, information: DataFrame, rtol: float = 1e-9) -> DataFrame:
    """(world, i, informed): whether evidence reached a raw variable, from prior (world, i, v) variances and the diagonal of
    information (world, i, k, v), posterior less prior precision; the floor follows each prior's own precision."""
    own = information.filter("i = k").select("world", "i", F.col("v").alias("gain"))
    return prior.join(own, ["world", "i"], "left").select("world", "i", _reached(F.col("gain"), F.col("v"), rtol).alias("informed"))


def ticket(jac: DataFrame, known: DataFrame, subjects: DataFrame) -> DataFrame:
    """(world, r, depends_on, uninformed, can_close): what each subject (world, r) depends on by its gradient jac (world, r, c, v), and
    which of that no evidence reached (known: :func:`informed`)."""
    deps = jac.filter("v <> 0").join(subjects, ["world", "r"], "left_semi").join(known.withColumnRenamed("i", "c"), ["world", "c"])
    g = deps.groupBy("world", "r").agg(F.count("*").alias("depends_on"), F.count_if(~F.col("informed")).alias("uninformed"))
    return g.withColumn("can_close", F.col("uninformed") == 0)


def _precision(noise: Column) -> Column:
    return 1 / F.when(noise > 0, noise).otherwise(F.raise_error(F.lit("an observation variance must be positive")))


def _grown(p: Column, values: Column, top: Column, rtol: float) -> Column:
    """How much a rank grows by one more eigenvalue p beside ``values``, whose largest is ``top``."""
    rank = lambda least: F.size(F.filter(values, lambda x: x > least))
    high = F.greatest(top, p)
    before, after = F.when(top > 0, rank(top * rtol)).otherwise(0), rank(high * rtol) + F.when(p > high * rtol, 1).otherwise(0)
    return after - before


def rank_gain(eigen: DataFrame, plans: DataFrame, rtol: float = 1e-10) -> DataFrame:
    """plans (world, i, noise) of variables that no information reaches, with gain: how much the rank of the information grows.

    eigen (world, v) are the eigenvalues of the information. An uninformed variable's row is empty, so its precision joins
    the eigenvalues as one more; a rank counts those beyond ``rtol`` of the largest, so that a precision far above all others
    can hide as many as it adds.
    """
    e = eigen.groupBy("world").agg(F.max(F.abs("v")).alias("top"), F.array_sort(F.collect_list(F.abs("v"))).alias("all"))
    p = plans.withColumn("p", _precision(F.col("noise"))).join(e, "world", "left").withColumns({"top": F.coalesce("top", F.lit(0.0)), "all": F.coalesce("all", F.array().cast("array<double>"))})
    return p.withColumn("gain", _grown(F.col("p"), F.col("all"), F.col("top"), rtol)).drop("p", "top", "all")


def coverage(jac: DataFrame, known: DataFrame, subjects: DataFrame, gains: DataFrame) -> DataFrame:
    """(world, needed, reached, uncovered, covers): of the uninformed variables that the subjects depend on, those that a plan reaches
    with a gain in rank; gains (world, i, gain) come from :func:`rank_gain`. Plans elsewhere count for nothing."""
    deps = jac.filter("v <> 0").join(subjects, ["world", "r"], "left_semi").select("world", F.col("c").alias("i")).distinct()
    need = deps.join(known.filter("NOT informed"), ["world", "i"], "left_semi")
    got = gains.filter("gain > 0").select("world", "i").distinct().withColumn("got", F.lit(True))
    g = need.join(got, ["world", "i"], "left").groupBy("world").agg(F.count("*").alias("needed"), F.count("got").alias("reached"))
    out = subjects.select("world").distinct().join(g, "world", "left").select("world", F.coalesce("needed", F.lit(0)).alias("needed"), F.coalesce("reached", F.lit(0)).alias("reached"))
    return out.withColumns({"uncovered": F.col("needed") - F.col("reached"), "covers": F.col("needed") == F.col("reached")})


def packed_coverage(worlds: DataFrame, floor: float = 1e-9, rtol: float = 1e-10) -> DataFrame:
    """(world, needed, reached, uncovered, covers) as :func:`coverage` tells, of worlds in one row each: a step for each row, no join.

    worlds (world, variables), an array of (needed, prior, gain, noise): whether the subjects depend on it, its variance, its
    cell of a diagonal information or null, and the noise of a planned observation or null. Plans of informed variables don't count.
    """
    w = worlds.withColumn("values", F.transform(F.filter("variables", lambda x: x["gain"].isNotNull()), lambda x: F.abs(x["gain"])))
    w = w.withColumn("top", F.coalesce(F.array_max("values"), F.lit(0.0)))
    need = F.filter("variables", lambda x: x["needed"] & ~_reached(x["gain"], x["prior"], floor))
    got = lambda x: x["noise"].isNotNull() & (_grown(_precision(x["noise"]), F.col("values"), F.col("top"), rtol) > 0)
    w = w.withColumn("need", need).select("world", F.size("need").cast("long").alias("needed"), F.size(F.filter("need", got)).cast("long").alias("reached"))
    return w.withColumns({"uncovered": F.col("needed") - F.col("reached"), "covers": F.col("needed") == F.col("reached")})

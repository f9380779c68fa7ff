"""Hard constraints, opening hours, scoring, diversity and top-K of candidate spots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, scores

DAY = 1440


@dataclass(frozen=True)
class Request:
    """One visit: limits, preferences and mode."""

    mode: str = "scenario"
    transport: str = "walking"
    max_minutes: float = 40.0
    max_walk: float = 2400.0
    stay: int = 45
    leave: int = 18 * 60
    until: int = 21 * 60
    preferences: tuple[str, ...] = ("nature", "river")
    crowd: str = "quiet"
    wheelchair: bool = False
    stroller: bool = False
    no_stairs: bool = True
    max_slope: float | None = 8.0
    labels: dict = field(default_factory=dict)


def trusted(status: Column, request: Request) -> Column:
    ok = status == "verified"
    if request.mode == "scenario":
        ok = ok | (status == "scenario")
    return F.coalesce(ok, F.lit(False))


def evidence_current(status: Column, reference: Column, begins: Column, ends: Column, basis: Column, at: Column, request: Request) -> Column:
    """Evidence that holds at a time (all times in minutes).

    An observation holds two hours; a forecast or estimate needs an interval around the
    time and a reference before it; resident counts are no evidence of a crowd.
    """
    age = at - reference
    observed = age.between(0, 120)
    both = begins.isNotNull() & ends.isNotNull()
    within = at.between(begins, ends) & (reference <= at)
    dated = F.when((status == "observed") & ~observed, F.lit(False)).when(both, within).otherwise(status == "observed")
    kind = status.isin("observed", "forecast", "estimated") & ~F.coalesce(basis == "residential_population", F.lit(False)) & reference.isNotNull()
    return F.coalesce(F.when(status == "scenario", F.lit(request.mode == "scenario")).otherwise(kind & dated), F.lit(False))


def hours_cover(hours: Column, arrival: Column, departure: Column) -> Column:
    """A stay lies within one stretch of opening time; touching intervals join.

    hours: ARRAY<STRUCT<start INT, stop INT>> in minutes of the day; a stop that is not
    after the start is on the next day. Null hours are unknown, an empty list is closed.
    """
    first_day = F.floor(arrival / DAY) * DAY

    def spans(h: Column) -> Column:
        stop = F.when(h["stop"] > h["start"], h["stop"]).otherwise(h["stop"] + DAY)
        return F.transform(F.array(F.lit(-DAY), F.lit(0), F.lit(DAY)), lambda d: F.struct((first_day + d + h["start"]).cast("long").alias("a"), (first_day + d + stop).cast("long").alias("b")))

    every = F.array_sort(F.flatten(F.transform(hours, spans)))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def merge(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (x["a"] <= last["b"]), joined).otherwise(F.concat(done, F.array(x)))

    merged = F.aggregate(every, none, merge)
    return F.when(hours.isNotNull(), F.exists(merged, lambda m: (m["a"] <= arrival) & (departure <= m["b"])))


def constraints(spots: DataFrame, r: Request) -> DataFrame:
    """failures, unknown (codes), status, arrival and departure of each spot."""
    c = F.col
    fails: list[Column] = []
    open_: list[Column] = []

    def check(fail: Column | None, unknown: Column | None, code: str) -> None:
        if fail is not None:
            fails.append(F.when(fail, code))
        if unknown is not None:
            open_.append(F.when(unknown if fail is None else (~F.coalesce(fail, F.lit(False)) & unknown), code))

    no = F.lit(False)
    same_mode = F.coalesce(c("route_mode") == r.transport, no)
    route_ok = trusted(c("route_status"), r) & same_mode
    minutes = F.when(c("minutes") >= 0, c("minutes"))
    check(F.coalesce(c("visibility").isin("blocked", "excluded"), no), F.coalesce(c("visibility") != "visible", F.lit(True)), "visibility")
    if r.mode != "scenario":
        check(None, F.coalesce(c("evidence_kind") == "scenario", no), "fictional")
    check(None, ~same_mode, "route_mode")
    check(F.coalesce(minutes > r.max_minutes, no), minutes.isNull() | ~route_ok, "travel")
    check(F.coalesce(c("walk_m") > r.max_walk, no), F.coalesce(c("walk_m") < 0, F.lit(True)) | ~route_ok, "walk")
    check(F.coalesce(~c("public"), no), ~F.coalesce(c("public"), no) | ~trusted(c("public_status"), r), "public")
    stepped = F.coalesce(~c("step_free"), no)
    not_proven = ~F.coalesce(c("step_free"), no) | ~route_ok
    for asked, column, code in ((r.wheelchair, "wheelchair", "wheelchair"), (r.stroller, "stroller", "stroller")):
        if asked:
            check(F.coalesce(~c(column), no) | stepped, ~F.coalesce(c(column), no) | not_proven, code)
    if r.no_stairs:
        check(F.coalesce(c("stairs"), no) | stepped, F.coalesce(c("stairs"), F.lit(True)) | not_proven, "stairs")
    if r.max_slope is not None:
        unproven = c("slope").isNull() | ~route_ok
        check(~unproven & (c("slope") > r.max_slope), unproven, "slope")
    arrival = r.leave + minutes
    departure = arrival + r.stay
    check(F.coalesce(departure > r.until, no), None, "window")
    covered = hours_cover(c("hours"), arrival, departure)
    check(F.coalesce(minutes.isNotNull() & ~covered, no), minutes.isNotNull() & (covered.isNull() | ~trusted(c("hours_status"), r)), "hours")
    check(None, minutes.isNull(), "arrival")
    out = spots.withColumn("failures", F.array_compact(F.array(*fails))).withColumn("unknown", F.array_compact(F.array(*open_)))
    status = F.when(F.size("failures") > 0, "failed").when(F.size("unknown") > 0, "unverified").otherwise("passed")
    return out.withColumn("status", status).withColumn("arrival", arrival).withColumn("departure", departure)


def criteria(r: Request) -> dict[str, Column]:
    """The five criteria of a spot that constraints() has seen."""
    c = F.col
    wanted = F.array(*[F.lit(p) for p in r.preferences])
    shown = c("features_status").isin(*(["verified", "computed", "estimated"] + ["scenario"] * (r.mode == "scenario")))
    composed = F.when(trusted(c("composition_status"), r), F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("composition"))))
    routed = c("route_status").isin(*(["verified", "estimated"] + ["scenario"] * (r.mode == "scenario"))) & (c("route_mode") == r.transport)
    crowd = F.lit(None).cast("double") if r.crowd == "any" else F.when(c("crowd_current"), scores.crowd(F.lit(r.crowd), c("crowd_level")))
    return {
        "preferences": F.when(shown, scores.preference(c("features"), wanted)),
        "visibility": F.when(c("visibility") == "visible", F.coalesce(composed, F.lit(60.0))),
        "time_weather": F.coalesce(c("time_score"), F.when(c("weather_current"), scores.weather(c("rain"), c("wind"), c("sight")))),
        "travel": F.when(routed, scores.travel(c("minutes"), F.lit(r.max_minutes))),
        "crowd": crowd,
    }


def overridden(value: Column, override: Column) -> Column:
    """A supplied score replaces a criterion that has evidence; it must be 0 to 100."""
    fine = F.when(override.between(0, 100), override).otherwise(F.raise_error(F.lit("a criterion must be between 0 and 100")).cast("double"))
    return F.when(value.isNotNull() & override.isNotNull(), fine).otherwise(value)


def scored(spots: DataFrame, r: Request) -> DataFrame:
    """score and coverage of every spot, failed ones too."""
    score, known = scores.renormalised(criteria(r))
    return spots.withColumn("score", score).withColumn("coverage", known)




def same_experience(a: Column, b: Column) -> Column:
    gap = geo.angle_gap(a["bearing"], b["bearing"]) <= 20
    near = geo.haversine(a["lon"], a["lat"], b["lon"], b["lat"]) <= 120
    targets = (F.size(a["targets"]) > 0) & (a["targets"] == b["targets"])
    return F.coalesce(gap & near & targets & (a["signature"] != "") & (a["signature"] == b["signature"]), F.lit(False))


#: Ids of equal spots that are paired with others in one row.
TOGETHER = 256


def same_pairs(spots: DataFrame, keys: list[str]) -> DataFrame:
    """first, second: ids, the smaller first, of all spots of the same experience. Spots must
    agree in keys, which targets and signature follow from.

    Spots that differ in the id alone are compared once, in both directions; what holds for them
    holds for all of their ids, which are then paired in rows of at most TOGETHER from each side.
    """
    like = F.struct("lon", "lat", "bearing", "targets", "signature").alias("v")
    each = spots.filter(F.col("id").isNotNull()).select(*keys, F.floor(F.col("bearing") / 20).cast("int").alias("sector"), like, "id")
    turn = F.row_number().over(Window.partitionBy(*keys, "sector", "v").orderBy("id"))
    each = each.withColumn("batch", F.floor((turn - 1) / TOGETHER))
    some = each.groupBy(*keys, "sector", "v", "batch").agg(F.collect_list("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"))
    around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: F.pmod(F.col("sector") + x, F.lit(18)))
    wide = some.select(*keys, F.explode(around).alias("sector"), F.col("v").alias("w"), F.col("ids").alias("others"), F.col("high").alias("most"), F.col("batch").alias("other"))
    both = some.join(wide, [*keys, "sector"]).filter(F.col("low") < F.col("most")).filter(same_experience(F.col("w"), F.col("v")))
    context = spots.sparkSession.sparkContext
    both = both.select("ids", "others", "low", "most").repartition(16 * context.defaultParallelism, "low", "most")
    return both.select(F.explode("ids").alias("first"), "others").select("first", F.explode("others").alias("second")).filter(F.col("first") < F.col("second"))


def greedy(rows: DataFrame, group: list[str], row: Column, order: Column, redundant, k: int | None = None) -> DataFrame:
    """The rows of each group that are kept when taken in order and dropped if redundant
    with one kept before; at most k. row: a struct; order: a sortable column.

    A fold over the ordered array of a group, within one row: the order decides, so no
    join states it. Groups are the candidates of one request.
    """
    ordered = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("v")))).alias("every"))
    kind = ordered.schema["every"].dataType.elementType["v"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")

    def take(kept: Column, x: Column) -> Column:
        full = F.lit(False) if k is None else F.size(kept) >= k
        return F.when(full | F.exists(kept, lambda y: redundant(x["v"], y)), kept).otherwise(F.concat(kept, F.array(x["v"])))

    kept = ordered.select(*group, F.aggregate("every", none, take).alias("kept"))
    return kept.select(*group, F.posexplode("kept").alias("n", "v")).select(*group, (F.col("n") + 1).alias("place"), "v.*")


def greedy_top(rows: DataFrame, row: Column, order: Column, redundant, k: int) -> DataFrame:
    """place and the first k rows of greedy() over the whole table, without a fold over it:
    k times the best row that is left is taken, and those like it are filtered out."""
    left = rows.select(row.alias("v"), order.alias("o"))
    kind, found = left.schema["v"].dataType, []
    for _ in range(k):
        best = left.orderBy("o").limit(1).select(F.to_json("v", {"ignoreNullFields": "false"}).alias("j")).collect()
        if not best:
            break
        found.append(best[0]["j"])
        taken = F.from_json(F.lit(best[0]["j"]), kind)
        left = left.filter(~F.coalesce(redundant(F.col("v"), taken), F.lit(False)) & ~F.col("v").eqNullSafe(taken))
    made = rows.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("place"), F.from_json(F.lit(j), kind).alias("v")) for i, j in enumerate(found)])).alias("r")) if found else None
    return made.select("r.place", "r.v.*") if made is not None else left.limit(0).select(F.lit(1).alias("place"), "v.*")


def representatives(rows: DataFrame, row: Column, order: list[Column], key: list[str]) -> DataFrame:
    """place and row of the spots that stand for like ones, best first.

    Only spots of equal targets and signature (key) can be like each other, so each such
    group is a fold of its own; spots without either stand for themselves. The kept ones are
    then put in one order.
    """
    from .ordered import ranked

    names = [f"o{i}" for i in range(len(order))]
    whole = F.struct(row.alias("r"), *[c.alias(n) for c, n in zip(order, names, strict=True)])
    like = lambda a, b: same_experience(a["r"], b["r"])
    alone = F.coalesce((F.size("targets") <= 0) | (F.col("signature") == ""), F.lit(True))
    kept = greedy(rows.filter(~alone), key, whole, F.struct(*[c.alias(n) for c, n in zip(order, names, strict=True)]), like)
    every = kept.select("r", *names).unionByName(rows.filter(alone).select(whole.alias("w")).select("w.*"))
    return ranked(every, [F.col(n) for n in names]).select("place", "r.*")


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """The k best by score (unknown last), coverage and id, with the shortfall."""
    best = rows.orderBy(F.col("score").desc_nulls_last(), F.col("coverage").desc(), F.col("id")).limit(k)
    place = F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), F.col("coverage").desc(), F.col("id")))
    return best.withColumn("place", place)

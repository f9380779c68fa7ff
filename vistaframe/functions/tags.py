"""Rules over map tags (MAP<STRING,STRING>; an absent key is not "no")."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules
CLOSED_FOOT = ("no", "private", "customers", "destination", "use_sidepath")
OPEN_FOOT = ("yes", "designated", "official")
ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "unclassified", "living_street", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link")
PEDESTRIAN = ("footway", "path", "pedestrian", "steps", "living_street", "residential", "service", "unclassified", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link", "track", "cycleway")


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def has(tags: Column, *keys: str) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.map_contains_key(tags, k)
    return out


def among(tags: Column, key: str, *values: str) -> Column:
    """The tag is one of the values (false if absent)."""
    return F.coalesce(tag(tags, key).isin(*values), F.lit(False))


def set_to_other(tags: Column, key: str, neutral: str) -> Column:
    return F.coalesce(tag(tags, key) != neutral, F.lit(False))


def _filled(tags: Column, key: str) -> Column:
    return F.coalesce(tag(tags, key) != "", F.lit(False))


def access_policy(tags: Column, elevation_status: Column | None = None) -> Column:
    """struct(state, reason): excluded, exploratory_only or map_supported; the first rule that fits."""
    raised = set_to_other(tags, "bridge", "no") | set_to_other(tags, "tunnel", "no") | set_to_other(tags, "layer", "0") | among(tags, "highway", "steps")
    if elevation_status is not None:
        raised = raised | F.coalesce(elevation_status == "unsupported_structure", F.lit(False))
    walk = among(tags, "highway", "footway", "pedestrian") | (among(tags, "highway", "path", "cycleway") & among(tags, "foot", "yes", "designated", "permissive"))
    rules = [
        (among(tags, "access", "no", "private", "customers", "permit", "military") | among(tags, "foot", "no", "private", "use_sidepath"), "excluded", "mapped_access_restriction"),
        (among(tags, "highway", "construction") | _filled(tags, "construction") | among(tags, "disused", "yes") | among(tags, "indoor", "yes"), "excluded", "unusable_or_indoor"),
        (raised, "excluded", "unsupported_structure_or_step_elevation"),
        (_filled(tags, "opening_hours") | _filled(tags, "access:conditional") | _filled(tags, "foot:conditional") | among(tags, "barrier", "gate", "lift_gate", "turnstile"), "exploratory_only", "schedule_or_gate_unresolved"),
        (among(tags, "highway", *ROADS, "track"), "excluded", "road_carriageway_or_track_centerline"),
        (~walk, "exploratory_only", "pedestrian_access_unresolved"),
        (tag(tags, "access").isNotNull() & ~among(tags, "access", "yes", "permissive", "designated"), "exploratory_only", "uninterpreted_access"),
    ]
    out = F.struct(F.lit("map_supported").alias("state"), F.lit("dedicated_mapped_pedestrian_use").alias("reason"))
    for rule, state, reason in reversed(rules):
        out = F.when(rule, F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def access_evidence(tags: Column) -> Column:
    use = F.coalesce(tag(tags, "foot"), tag(tags, "access"))
    return (
        F.when(has(tags, "foot:conditional", "access:conditional"), "conditional_unresolved")
        .when(use.isin(*CLOSED_FOOT), "restricted")
        .when(use.isin(*OPEN_FOOT), "mapped_permission_unverified")
        .when(use == "permissive", "permissive_unverified")
        .otherwise("unknown")
    )


def edge_access(tags: Column) -> Column:
    use = F.coalesce(tag(tags, "foot"), tag(tags, "access"))
    return (
        F.when(has(tags, "foot:conditional", "access:conditional"), "unknown")
        .when(use.isin(*CLOSED_FOOT), "prohibited")
        .when(use.isin(*OPEN_FOOT), "verified")
        .when(use == "permissive", "estimated")
        .otherwise("unknown")
    )


def categories(tags: Column) -> Column:
    """Map layers of an object, each once, in a fixed order."""
    walk = among(tags, "highway", *PEDESTRIAN) | (_filled(tags, "highway") & among(tags, "foot", "yes", "designated"))
    area = among(tags, "area", "yes")
    rules = [
        (walk & area, "public_spaces"),
        (walk & ~area, "paths"),
        (among(tags, "leisure", "park", "garden", "recreation_ground", "common") | among(tags, "place", "square"), "public_spaces"),
        (among(tags, "natural", "water") | among(tags, "waterway", "river", "stream", "canal", "riverbank", "drain", "ditch") | among(tags, "landuse", "reservoir"), "water"),
        (among(tags, "natural", "wood", "scrub", "grassland", "heath", "wetland") | among(tags, "landuse", "forest", "grass", "meadow", "orchard") | among(tags, "leisure", "park"), "green_space"),
        (among(tags, "natural", "peak", "ridge", "saddle", "cliff"), "peaks_ridges"),
        (set_to_other(tags, "bridge", "no") | among(tags, "man_made", "bridge"), "bridges"),
        (among(tags, "tourism", "attraction", "museum", "artwork") | among(tags, "historic", "monument", "memorial", "castle", "ruins", "archaeological_site") | among(tags, "man_made", "tower", "lighthouse") | among(tags, "natural", "peak"), "landmarks"),
        (has(tags, "barrier"), "barriers"),
        (among(tags, "boundary", "administrative") & among(tags, "admin_level", "6", "7", "8", "9", "10"), "boundaries"),
    ]
    return F.array_distinct(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules])))


def diagnostic_class(tags: Column) -> Column:
    return (
        F.when(among(tags, "boundary", "administrative") | has(tags, "admin_level"), "administrative")
        .when(among(tags, "natural", "water", "bay") | has(tags, "water", "waterway"), "water")
        .when(among(tags, "man_made", "bridge") | has(tags, "bridge"), "bridge")
        .when(among(tags, "natural", "wood", "scrub") | among(tags, "landuse", "forest"), "woodland")
        .when(among(tags, "leisure", "park", "garden", "nature_reserve", "recreation_ground") | among(tags, "highway", "pedestrian"), "public_space")
        .when(_filled(tags, "building") | _filled(tags, "building:part"), "building")
        .otherwise("other")
    )


def pedestrian_area(tags: Column) -> Column:
    shut = access_evidence(tags).isin("restricted", "conditional_unresolved")
    return ~shut & ((among(tags, "highway", "pedestrian") & among(tags, "area", "yes")) | (among(tags, "place", "square") & among(tags, "foot", *OPEN_FOOT)))


def traversable(tags: Column, barriers: Column, access_status: Column, steps: Column, wheelchair: Column, stroller: Column, no_stairs: Column) -> Column:
    """An edge may be walked under a request. barriers: ARRAY<MAP<STRING,STRING>>."""
    free = ("yes", "designated", "permissive")

    def stops(b: Column) -> Column:
        return (
            among(b, "locked", "yes")
            | among(b, "foot", "no", "private")
            | (among(b, "access", "no", "private") & ~among(b, "foot", *free))
            | (wheelchair & among(b, "wheelchair", "no"))
        )

    shut = F.coalesce(access_status == "prohibited", F.lit(False)) | among(tags, "foot", "no", "private") | (among(tags, "access", "no", "private") & ~among(tags, "foot", *free))
    stairs = F.coalesce(steps, F.lit(False)) | among(tags, "highway", "steps")
    return ~F.exists(barriers, stops) & ~shut & ~((no_stairs | wheelchair | stroller) & stairs) & ~(wheelchair & among(tags, "wheelchair", "no"))

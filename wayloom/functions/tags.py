"""Road attributes from a map<string, string> of tags, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tagging scheme and the car profile.
ROAD_CLASSES = "other motorway trunk primary secondary tertiary residential unclassified service road track bridleway steps cycleway path living_street footway pedestrian platform corridor construction busway".split()
ROAD_ACCESS = "yes destination customers delivery private agricultural forestry no".split()
RESTRICTION_KEYS = {"car": "motorcar motor_vehicle vehicle access".split(), "bike": "bicycle vehicle access".split(), "foot": "foot access".split(), "motorcycle": "motorcycle motor_vehicle vehicle access".split(), "hgv": "hgv motor_vehicle vehicle access".split()}
ALLOWED = "yes designated official permissive destination".split()
RESTRICTED = "no restricted military emergency private permit agricultural forestry delivery".split()
CAR_HIGHWAYS = "motorway motorway_link trunk trunk_link primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential living_street service road track pedestrian".split()
CAR_TRACKS = "grade1 grade2 grade3".split()
BARRIERS = "kissing_gate fence bollard stile turnstile cycle_barrier motorcycle_barrier block bus_trap sump_buster jersey_barrier".split()
SPEEDS = {"motorway": 100, "motorway_link": 70, "trunk": 70, "trunk_link": 65, "primary": 65, "primary_link": 60, "secondary": 60, "secondary_link": 50, "tertiary": 50, "tertiary_link": 40, "unclassified": 30, "residential": 30, "living_street": 6, "pedestrian": 6, "service": 20, "road": 20, "track": 15}
TRACK_SPEEDS = {"grade1": 20, "grade2": 15, "grade3": 10}
BAD_SURFACES = "cobblestone grass_paver gravel sand paving_stones dirt ground grass unpaved compacted wood pebblestone fine_gravel earth sett unhewn_cobblestone".split()
BAD_SURFACE_SPEED, OTHER_SPEED, MOST_STORED, SPEED_STEP = 30, 10, 254, 2
FAST_ROADS = "motorway motorway_link trunk trunk_link primary".split()


def tag(tags: Column, key: str) -> Column:
    """A tag's value, empty where it is missing."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def looked_up(value: Column, table: dict, default) -> Column:
    out = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value), F.lit(default))
    return out


def any_part(value: Column, wanted: list[str]) -> Column:
    return F.exists(F.split(value, ";"), lambda p: F.trim(p).isin(wanted))


def roundabout(tags: Column) -> Column:
    return tag(tags, "junction").isin("roundabout", "circular")


def road_class(tags: Column) -> Column:
    highway = tag(tags, "highway")
    bare = F.regexp_replace(highway, "_link$", "")
    return F.when(highway.isin(ROAD_CLASSES), highway).when(bare.isin(ROAD_CLASSES), bare).otherwise("other")


def road_class_link(tags: Column) -> Column:
    return tag(tags, "highway").endswith("_link")


def is_ferry(tags: Column) -> Column:
    route = tag(tags, "route")
    return ((route == "ferry") & (tag(tags, "ferry") != "no")) | ((route == "shuttle_train") & (tag(tags, "shuttle_train") != "no"))


def road_environment(tags: Column) -> Column:
    has = lambda k: ~tag(tags, k).isin("", "no")
    return F.when(is_ferry(tags), "ferry").when(has("bridge"), "bridge").when(has("tunnel"), "tunnel").when((tag(tags, "ford") != "") | (tag(tags, "highway") == "ford"), "ford").when(tag(tags, "highway") != "", "road").otherwise("other")


def speed_value(text: Column) -> Column:
    """km/h of a speed tag; -1 without a limit, null where it can't be read."""
    text = F.trim(text)
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z/]*)$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z/]*)$", 2)
    factor = F.when(unit.isin("", "km/h", "kmh", "kph"), 1.0).when(unit == "mph", 1.609344).when(unit == "knots", 1.852)
    kmh = number * factor
    return F.when(text.isin("none", "unlimited"), -1.0).when(text.isin("walk", "living_street"), 6.0).when(kmh >= 4.8, kmh)


def max_speed(tags: Column, reverse: bool = False) -> Column:
    """km/h, 150 at most; null where there is none. A direction's own tag goes first."""
    own = speed_value(tag(tags, "maxspeed:backward" if reverse else "maxspeed:forward"))
    value = F.coalesce(own, speed_value(tag(tags, "maxspeed")))
    return F.when(value == -1, F.when(tag(tags, "highway").isin(FAST_ROADS), 150.0)).when(value > 0, F.least(value, F.lit(150.0)))


def road_access(tags: Column, mode: str = "car") -> Column:
    """The most permissive value among all parts of the mode's tags."""
    parts = F.flatten(F.array(*[F.split(tag(tags, k), ";") for k in RESTRICTION_KEYS[mode]]))
    place = lambda p: F.when(F.lower(F.trim(p)).isin("permit", "service"), ROAD_ACCESS.index("private")).otherwise(F.array_position(F.array(*map(F.lit, ROAD_ACCESS)), F.lower(F.trim(p))).cast("int") - 1)
    found = F.array_min(F.filter(F.transform(parts, place), lambda x: x >= 0))
    return F.get(F.array(*map(F.lit, ROAD_ACCESS)), F.coalesce(found, F.lit(0)))


def duration_seconds(text: Column) -> Column:
    """Seconds of minutes, hh:mm, hh:mm:ss and ISO 8601 (years of 365 and months of 31 days); null where it can't be read."""
    part = lambda k: F.split(text, ":").getItem(k).try_cast("long")
    iso = r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    seconds = [31_536_000, 2_678_400, 86_400, 3600, 60, 1]
    whole = sum((F.coalesce(F.regexp_extract(text, iso, k + 1).try_cast("long"), F.lit(0)) * s for k, s in enumerate(seconds[1:], 1)), F.coalesce(F.regexp_extract(text, iso, 1).try_cast("long"), F.lit(0)) * seconds[0])
    return F.when(text.rlike(r"^\d+$"), text.try_cast("long") * 60).when(text.rlike(r"^\d+:\d+$"), part(0) * 3600 + part(1) * 60).when(text.rlike(r"^\d+:\d+:\d+$"), part(0) * 3600 + part(1) * 60 + part(2)).when(text.rlike(iso) & (F.length(text) > 1), whole)


def ferry_speed(speed_from_duration: Column, way_metres: Column) -> Column:
    return F.least(F.greatest(F.when(speed_from_duration.isNotNull(), F.round(speed_from_duration / 1.4)).when(way_metres < 500, 1.0).otherwise(6.0), F.lit(2.0)), F.lit(62.0))


def _restrictions(tags: Column, keys: list[str]) -> Column:
    """Whether the restriction tags let the way stay; the first key with a known value decides."""
    out = tag(tags, "service") != "emergency_access"
    for i in range(len(keys) - 1, -1, -1):
        value = tag(tags, keys[i])
        higher = F.lit(False)
        for k in keys[: i + 1]:
            rule = tag(tags, k + ":conditional")
            higher = higher | (F.contains(rule, F.lit("@")) & F.trim(F.substring_index(rule, "@", 1)).isin(ALLOWED))
        out = F.when((value != "") & any_part(value, ALLOWED), True).when((value != "") & any_part(value, RESTRICTED), higher).otherwise(out)
    return out


def car_access(tags: Column) -> Column:
    """'way', 'ferry' or null where cars can't go."""
    keys, highway = RESTRICTION_KEYS["car"], tag(tags, "highway")
    first = F.coalesce(*[F.nullif(tag(tags, k), F.lit("")) for k in keys], F.lit(""))
    ferry = (first.isin(ALLOWED) | ((first == "") & (tag(tags, "foot") == "") & (tag(tags, "bicycle") == "")) | (tag(tags, "hgv") == "yes")) & (highway == "")
    walked = F.lit(False)
    for k in reversed(keys):
        rule = tag(tags, k + ":conditional")
        allowed = F.contains(rule, F.lit("@")) & F.trim(F.substring_index(rule, "@", 1)).isin(ALLOWED)
        walked = F.when(tag(tags, k).isin(ALLOWED), True).when(tag(tags, k).isin(RESTRICTED), False).when(allowed, True).otherwise(walked)
    track = (highway != "track") | tag(tags, "tracktype").isin(*CAR_TRACKS, "")
    road = highway.isin(CAR_HIGHWAYS) & track & _restrictions(tags, keys)
    return F.when(highway == "pedestrian", F.when(walked, "way")).when(is_ferry(tags), F.when(ferry, "ferry")).when(road, "way")


def car_directions(tags: Column) -> tuple[Column, Column]:
    """Whether a car may go forward, backward."""
    access, oneway = car_access(tags), tag(tags, "oneway")
    no = lambda way: F.greatest(*[tag(tags, f"{k}:{way}") == "no" for k in ("vehicle", "motor_vehicle", "motorcar")])
    forward_only = oneway.isin("yes", "1", "true") | no("backward") | roundabout(tags)
    backward_only = oneway.isin("-1", "reverse") | no("forward")
    open_ = access.isNotNull()
    is_boat = access == "ferry"
    single = forward_only | backward_only
    return open_ & (F.coalesce(is_boat, F.lit(False)) | ~single | ~backward_only), open_ & (F.coalesce(is_boat, F.lit(False)) | ~single | (backward_only & ~roundabout(tags)))


def car_speed(tags: Column, ferry: Column | None = None, reverse: bool = False) -> Column:
    """Stored km/h: in steps of 2, at least 2."""
    highway, limit = tag(tags, "highway"), max_speed(tags, reverse)
    base = F.when((highway == "track") & tag(tags, "tracktype").isin(CAR_TRACKS), looked_up(tag(tags, "tracktype"), TRACK_SPEEDS, OTHER_SPEED)).otherwise(looked_up(highway, SPEEDS, OTHER_SPEED)).cast("double")
    base = F.when(tag(tags, "surface").isin(BAD_SURFACES), F.least(base, F.lit(float(BAD_SURFACE_SPEED)))).otherwise(base)
    road = F.when(limit.isNotNull(), F.least(limit * 0.9, F.lit(float(MOST_STORED)))).otherwise(base)
    value = F.when(is_ferry(tags), F.coalesce(ferry if ferry is not None else F.lit(None).cast("double"), F.lit(6.0))).otherwise(road)
    return F.greatest(F.round(value / SPEED_STEP) * SPEED_STEP, F.lit(float(SPEED_STEP)))


def is_barrier(tags: Column, block_fords: bool = True) -> Column:
    """Whether a node stops cars: by its access tags where it has a barrier, else by the kind of barrier, or as a ford."""
    ford = tag(tags, "ford").isin("yes", "pond") if block_fords else F.lit(False)
    decided = tag(tags, "barrier").isin(BARRIERS) | ford
    for k in reversed(RESTRICTION_KEYS["car"]):
        decided = F.when(tag(tags, k).isin(RESTRICTED), True).when(tag(tags, k).isin(ALLOWED), False).otherwise(decided)
    return F.when(tag(tags, "barrier") == "", ford).otherwise(decided)


def kept_node_tags(tags: Column) -> Column:
    """A node's tags, without notes, where one of them matters on a road; otherwise none."""
    keys = F.map_keys(tags)
    noted = F.map_filter(tags, lambda k, _: ~k.isin("created_by", "source", "note", "fixme"))
    return F.when(F.arrays_overlap(keys, F.array(*map(F.lit, ("barrier", "highway", "railway", "crossing", "ford")))), noted)


def duration_speed(metres: Column, seconds: Column) -> Column:
    """km/h of a way that takes seconds; null below 0.1 and where either is unknown."""
    kmh = metres / 1000 / F.nullif(seconds / 3600, F.lit(0.0))
    return F.when(kmh >= 0.1, kmh)


def way_names(tags: Column, first_node_tags: Column | None = None, language: str = "") -> Column:
    """name, ref, destination, destination_ref and, on motorways, the junction named at the first node; null where there is none."""
    clean = lambda v: F.nullif(F.trim(cut_bytes(F.regexp_replace(v, "; *", ", "), 256)), F.lit(""))
    junction = F.when((tag(first_node_tags, "highway") == "motorway_junction"), clean(tag(first_node_tags, "name"))) if first_node_tags is not None else F.lit(None).cast("string")
    return F.struct(
        F.nullif(street_name(tags, language), F.lit("")).alias("name"), clean(tag(tags, "ref")).alias("ref"), clean(tag(tags, "destination")).alias("destination"),
        clean(tag(tags, "destination:ref")).alias("destination_ref"), junction.alias("junction"),
    )


def cut_bytes(text: Column, n: int) -> Column:
    """text cut to n bytes of UTF-8, without a broken code point at the end."""
    whole = F.encode(text, "UTF-8")
    part = F.try_validate_utf8(F.substring(whole, 1, n).cast("string"))
    shorter = F.coalesce(part, *[F.try_validate_utf8(F.substring(whole, 1, n - k).cast("string")) for k in (1, 2, 3)])
    return F.when(F.octet_length(text) <= n, text).otherwise(shorter)


def checked_way_id(way: Column) -> Column:
    """The id as it is stored, in 31 bits; larger ones are an error."""
    return F.when(way < 1 << 31, way).otherwise(F.raise_error(F.lit("a way id needs more than 31 bits")).cast("long"))


def without_barriers(forward: Column, backward: Column, barrier: Column) -> tuple[Column, Column]:
    """Access in both directions, which a barrier edge closes."""
    return forward & ~barrier, backward & ~barrier


def accepted_way(tags: Column, n_refs: Column, ignored: list[str] = ()) -> Column:
    highway = tag(tags, "highway")
    other = (tag(tags, "route") != "") | (tag(tags, "man_made") == "pier") | (tag(tags, "railway") == "platform")
    return (n_refs >= 2) & (F.size(tags) > 0) & F.when(highway != "", ~highway.isin(*ignored) if ignored else F.lit(True)).otherwise(other)


def street_name(tags: Column, language: str = "") -> Column:
    own = [F.nullif(tag(tags, f"name:{language}"), F.lit(""))] if language else []
    name = F.coalesce(*own, F.nullif(tag(tags, "name"), F.lit("")))
    return F.trim(cut_bytes(F.regexp_replace(name, "; *", ", "), 256))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([A-Z])", "_$1"))

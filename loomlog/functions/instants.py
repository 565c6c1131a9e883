"""Written times to UTC instants: one regex alternation, one match per value, integer day arithmetic.

Every accepted form is one branch of ``PATTERN``; its components are named groups. The value is matched
once: a replacement lists all components, so no form costs a second scan. Ranges are checked on integers,
and the instant is assembled from a day number. Everything is a column expression.

Defined results: NULL, blank, unknown forms, impossible dates or clock times and unknown zone names give
NULL. Surrounding white space is ignored. Digits finer than microseconds are cut.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Minutes east of UTC of the zone letters.
LETTERS = {"UTC": 0, "GMT": 0, "JST": 540, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "PST": -480, "PDT": -420}
# Month names.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

_BLANK = r"[\s\p{Z}]"
_CLOCK = r"(?<{p}h>\d{{1,2}}):(?<{p}mi>\d{{2}})(?::(?<{p}s>\d{{2}})(?:[.,](?<{p}f>\d+))?)?"
_ZONE = (
    r"(?: ?(?:(?<{p}z>[Zz])|(?<{p}sg>[+-])(?<{p}oh>\d{{2}})(?::?(?<{p}om>\d{{2}}))?|(?<{p}l>"
    + "|".join(LETTERS)
    + r")|(?<{p}r>[A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)))?(?:\[(?<{p}b>[A-Za-z0-9_+/-]+)\])?"
)


def _zoned(p: str) -> str:
    return _CLOCK.format(p=p) + _ZONE.format(p=p)


#: prefix of the groups of each form -> its branch
FORMS = {
    # 2026-01-31T10:20:30.123+01:00[Europe/Berlin], 2026/01/31 10:20:30, 2026-01-31
    "i": r"(?<iy>\d{4})(?<isep>[-/])(?<imo>\d{1,2})\k<isep>(?<id>\d{1,2})(?:[Tt ]" + _zoned("i") + ")?",
    # 20260131T102030Z
    "c": r"(?<cy>\d{4})(?<cmo>\d{2})(?<cd>\d{2})[Tt](?<ch>\d{2})(?<cmi>\d{2})(?:(?<cs>\d{2})(?:[.,](?<cf>\d+))?)?" + _ZONE.format(p="c"),
    # 01/31/2026 10:20:30 PM
    "u": r"(?<umo>\d{1,2})/(?<ud>\d{1,2})/(?<uy>\d{4})(?: " + _CLOCK.format(p="u") + r"(?: ?(?<uap>[AaPp])[Mm])?" + _ZONE.format(p="u") + ")?",
    # Sat, 31 Jan 2026 10:20:30 +0100
    "m": r"(?:[A-Z][a-z]{2}, ?)?(?<md>\d{1,2}) (?<mmo>" + "|".join(MONTHS) + r") (?<my>\d{4}) " + _zoned("m"),
    # 2026年1月31日 10:20:30
    "j": r"(?<jy>\d{4})年(?<jmo>\d{1,2})月(?<jd>\d{1,2})日(?: ?" + _zoned("j") + ")?",
    # 1769850030, 1769850030123, 1769850030123456, each perhaps with a fraction
    "n": r"(?<nn>\d{15,16}|\d{12,13}|\d{9,10})(?:\.(?<nf>\d+))?",
}
PATTERN = f"^{_BLANK}*(?:" + "|".join(FORMS.values()) + f"){_BLANK}*$"
#: Values that are already in the one written form.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$"

_PARTS = ["y", "mo", "d", "h", "mi", "s", "f", "z", "sg", "oh", "om", "l", "r", "b", "ap", "n"]
_MARK = "\x01"
_HAS = {p: [part for part in _PARTS if f"(?<{p}{part}>" in branch] for p, branch in FORMS.items()}


def _replacement() -> str:
    out = []
    for part in _PARTS:
        out.append("".join(f"${{{p}{part}}}" for p, has in _HAS.items() if part in has and (p, part) != ("n", "f")))
    out.append("${nf}")
    return _MARK + _MARK.join(out)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by the public days-from-civil formula (all arguments bigint)."""
    div = lambda a, b: ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("bigint")
    y = y - (m <= 2).cast("bigint")
    era = div(y, 400)
    yoe = y - era * 400
    doy = div((m + F.when(m > 2, -3).otherwise(9)) * 153 + 2, 5) + d - 1
    return era * 146097 + yoe * 365 + div(yoe, 4) - div(yoe, 100) + doy - 719468


@cache
def _zones(_: str) -> list[str]:
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    return sorted(jvm.java.time.ZoneId.getAvailableZoneIds())


def known_zones() -> list[str]:
    return _zones(SparkSession.getActiveSession().sparkContext.applicationId)


def parse(value: Column) -> Column:
    """The components of ``value`` as an array of strings ('' where absent), or NULL where no form matches."""
    found = F.regexp_replace(value, PATTERN, _replacement())
    return F.when(found.startswith(_MARK), F.split(found, _MARK))


def needs_zone(value: Column) -> Column:
    """Whether reading ``value`` needs the zone of the machine that wrote it; NULL where no form matches."""
    stated = lambda p: F.concat(*[p[1 + _PARTS.index(k)] for k in ("z", "sg", "l", "r", "b", "n")])
    return F.transform(F.array(parse(value)), lambda p: stated(p) == "")[0]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _numbers(p: Column) -> Column:
    """Parsed parts -> struct of integers; NULL where a component is out of its range."""
    at = {k: p[1 + i] for i, k in enumerate([*_PARTS, "nf"])}
    num = lambda k: at[k].try_cast("bigint")
    zero = lambda k: F.coalesce(num(k), F.lit(0).cast("bigint"))
    micros = F.rpad(F.substring(at["nf"], 1, 6), 6, "0")
    month = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), at["mo"]), F.lit(0)), num("mo"))
    letters = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    size = F.length(at["n"])
    minutes = F.when((num("oh") <= 18) & (zero("om") <= 59), (num("oh") * 60 + zero("om")) * F.when(at["sg"] == "-", -1).otherwise(1))
    half = F.when(F.lower(at["ap"]) == "p", 12).otherwise(0)
    return F.struct(
        num("y").alias("y"), month.alias("m"), num("d").alias("d"), zero("mi").alias("mi"), zero("s").alias("s"),
        F.when(at["ap"] == "", zero("h")).when(zero("h").between(1, 12), zero("h") % 12 + half).alias("h"),
        F.rpad(F.substring(at["f"], 1, 6), 6, "0").try_cast("bigint").alias("f"),
        F.when(at["z"] != "", 0).when(at["sg"] != "", minutes).when(at["l"] != "", letters[at["l"]]).alias("off"),
        ((at["z"] != "") | (at["sg"] != "") | (at["l"] != "")).alias("states"),
        F.coalesce(F.nullif(at["r"], F.lit("")), F.nullif(at["b"], F.lit(""))).alias("region"),
        F.when(size == 0, None)
        .when(size <= 10, num("n") * 1_000_000 + micros.try_cast("bigint"))
        .when(size <= 13, num("n") * 1000 + F.substring(micros, 1, 3).try_cast("bigint"))
        .otherwise(num("n")).alias("plain"),
    )


def _local(t: Column) -> Column:
    """Microseconds of the wall clock, or NULL for an impossible date or time."""
    y, m, d = t["y"], t["m"], t["d"]
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= length) & t["h"].between(0, 23) & t["mi"].between(0, 59) & t["s"].between(0, 59)
    return F.when(ok, (days_from_civil(y, m, d) * 86400 + t["h"] * 3600 + t["mi"] * 60 + t["s"]) * 1_000_000 + t["f"])


def _settled(t: Column, local: Column, zone: Column) -> Column:
    region = F.coalesce(t["region"], zone, F.lit("UTC"))
    # A repeated or skipped hour takes the offset before the change.
    regional = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.when(region.isin(known_zones()), region)))
    dated = F.when(t["states"], local - t["off"] * 60_000_000).when(region == "UTC", local).otherwise(regional)
    return F.coalesce(t["plain"], dated)


def from_parts(parts: Column, zone: Column) -> Column:
    """Microseconds since 1970 UTC of parsed ``parts``; ``zone`` serves values that state none (NULL: UTC)."""
    return _let(parts, lambda p: F.when(p.isNotNull(), _let(_numbers(p), lambda t: _let(_local(t), lambda at: _settled(t, at, zone)))))


def from_canonical(value: Column) -> Column:
    """The same for values in the one written form, without the general pattern."""
    return F.unix_micros(F.try_to_timestamp(value))


def is_canonical(value: Column) -> Column:
    return value.rlike(CANONICAL)

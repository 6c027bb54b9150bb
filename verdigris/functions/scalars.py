"""Scalar rules as Column builders: fading, rounding, radii, scores, terrain, soil and labels.

Rounding is half to even on the scaled value (``rint(x * 10^d) / 10^d``), never Spark's half-up ``round``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rint(x: Column, digits: int = 0) -> Column:
    """Half-even rounding on the scaled value; the sum with 0 turns a negative zero into zero."""
    scale = 10.0**digits
    return F.rint(x * scale) / scale + 0.0 if digits else F.rint(x) + 0.0


def positive_fading(layers: Column, i: Column) -> Column:
    return F.exp(-(i - 0.5) * (0.7 * math.e**2) / layers)


def negative_fading(layers: Column, i: Column) -> Column:
    return 1.0 / (1.0 + F.exp((i - 0.5 - layers / 2.0) * (10.0 / layers)))


def ring_impact(initial: Column, layers: Column, level: Column) -> Column:
    """Impact of a ring: the source's own at level 0, faded with the level beyond it, to one digit."""
    fade = F.when(initial > 0, positive_fading(layers, level)).otherwise(negative_fading(layers, level))
    return F.when(level == 0, initial).otherwise(rint(fade * initial, 1))


def ring_width(radius: Column, layers: Column) -> Column:
    """Width of a ring, a whole number; one layer has no rings beyond the source."""
    return F.abs(rint(radius / F.nullif(layers - 1, F.lit(0))))


def min_max(x: Column, low: Column, high: Column, new_low: float = 0.0, new_high: float = 1.0) -> Column:
    """Linear map of [low, high] to [new_low, new_high]; not clamped, null where low = high."""
    return (x - low) / F.nullif(high - low, F.lit(0.0)) * (new_high - new_low) + new_low


def layer_count(radius: Column, low: Column, high: Column, least: int | Column = 2, most: int | Column = 10) -> Column:
    """Number of rings by the size of the radius; the middle when all radii are equal, and 2 at least."""
    least, most = (F.lit(c) for c in (least, most))
    scaled = F.rint(min_max(F.abs(radius), low, high, least.cast("double"), most.cast("double")))
    return F.greatest(F.when(low == high, F.floor((least + most) / 2).cast("int")).otherwise(scaled.cast("int")), F.lit(2))


#: Impact and fading of an industrial object by its level of danger, and for all other levels (fixed values).
DANGER_IMPACT = {1: -10, 2: -8, 3: -6, 4: -4}
DANGER_FADING = {1: 0.8, 2: 0.6, 3: 0.4, 4: 0.2}
OTHER_IMPACT, OTHER_FADING = -2, 0.1


def lookup(key: Column, table: dict, other=None) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for k, v in table.items():
        out = out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(other))


def danger_impact(level: Column) -> Column:
    return lookup(level, DANGER_IMPACT, OTHER_IMPACT)


def danger_fading(level: Column) -> Column:
    return lookup(level, DANGER_FADING, OTHER_FADING)


def impact_radius(impact: Column, fading: Column, area_factor: Column | float = 1.0) -> Column:
    """Signed radius in metres, to one digit."""
    return rint(impact * fading * area_factor * 1000.0, 1)


def default_name(name: Column, label: Column) -> Column:
    return F.coalesce(name, F.concat(label, F.lit(" без названия")))


def combined_impact(impact: Column, most: Column, least: Column, copies: Column | None = None) -> Column:
    """Aggregate: root of the sum of squares of each sign, capped by the largest impact of the sign, to one digit.

    One impact alone stays what it is. The closed form equals folding the sorted impacts with a running cap: once the
    running value reaches the cap it stays there. A row may stand for a number of ``copies``.
    """
    copies = F.lit(1) if copies is None else copies

    def side(flag: Column, cap: Column) -> Column:
        return F.least(F.sqrt(F.coalesce(F.sum(F.when(flag, copies * impact * impact)), F.lit(0.0))), F.abs(cap))

    several = side(impact > 0, most) - side(impact < 0, least)
    return rint(F.when(F.sum(F.when(impact.isNotNull(), copies)) == 1, F.max(impact)).otherwise(several), 1)


def score(all_positive: Column, all_negative: Column, mean: Column) -> Column:
    """Points of a territory from 0 to 5; a null mean (no data) has 0."""
    return (
        F.when(mean.isNull(), 0.0).when(all_positive, 5.0).when(all_negative, 0.0).when(mean >= 2, 4.0)
        .when(mean > 0, 3.0).when(mean == 0, 2.5).when(mean >= -4, 2.0).otherwise(1.0)
    )


def display_name(names: Column) -> Column:
    """One name as it is, several as a list in quotes."""
    quoted = F.array_join(F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ", ")
    return F.when(F.size(names) == 1, names[0]).when(F.size(names) > 1, F.concat(F.lit("Множество объектов: "), quoted)).otherwise(F.lit("Множество объектов"))


def report_line(number: Column, label: Column, names: Column) -> Column:
    """A numbered line of a report: the bare name when it says what it is, else the label and the name in quotes."""
    one = F.when(F.instr(names[0], label) > 0, names[0]).otherwise(F.concat(label, F.lit(': "'), names[0], F.lit('"')))
    many = F.concat(F.lit('Множество объектов типа "'), label, F.lit('":\n    '), F.array_join(F.transform(names, lambda n: F.concat(F.lit("- "), n)), "\n    "))
    return F.concat(number.cast("string"), F.lit(". "), F.when(F.size(names) == 1, one).otherwise(many))


def sign_collapse(impact: Column) -> Column:
    """Aggregate: of impacts of one sign the strongest; of mixed signs the one of largest size (the positive on ties)."""
    return F.when(F.max(impact) < 0, F.min(impact)).when(F.min(impact) > 0, F.max(impact)).otherwise(F.max_by(impact, F.struct(F.abs(impact), impact)))


def quantise(x: Column, step: float) -> Column:
    return F.rint(x / step) * step + 0.0


def slope(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan(F.hypot(dx, dy)))


def aspect(dx: Column, dy_row: Column) -> Column:
    """Direction of descent in degrees from north, clockwise; null on flat ground."""
    return F.when(F.hypot(dx, dy_row) >= 1e-9, F.pmod(F.degrees(F.atan2(-dx, dy_row)) + 360.0, F.lit(360.0)))


WINDS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def aspect_label(degrees: Column, step: float = 90.0) -> Column:
    """Wind names for steps of 90, 45 and 22.5 degrees, else the degrees of the class; empty for null."""
    n = int(round(360.0 / step))
    names = WINDS[:: 16 // n] if n in (4, 8, 16) and abs(360.0 / n - step) < 1e-9 else [f"{i * step % 360.0:g}°" for i in range(n)]
    index = F.pmod(F.rint(F.pmod(degrees, F.lit(360.0)) / step).cast("int"), F.lit(n))
    return F.when(degrees.isNull(), F.lit("")).otherwise(F.element_at(F.array(*map(F.lit, names)), index + 1))


def soil_texture(clay: Column, silt: Column, sand: Column) -> Column:
    """USDA texture class of three parts, which are scaled to 100 first; the first rule that fits holds."""
    total = clay + silt + sand
    c, s, a = (x / F.nullif(total, F.lit(0.0)) * 100.0 for x in (clay, silt, sand))
    rules = [
        ("clay", (c >= 40) & (s <= 40) & (a <= 45)),
        ("sandy clay", (a >= 45) & (c >= 35) & (c < 55)),
        ("silty clay", (s >= 40) & (c >= 40) & (a <= 20)),
        ("silty clay loam", s.between(40, 73) & (c >= 27) & (c < 40) & (a <= 20)),
        ("clay loam", (c >= 27) & (c < 40) & a.between(20, 45)),
        ("silt", (s >= 80) & (c <= 12) & (a <= 20)),
        ("silt loam", (s >= 50) & (c <= 27)),
        ("sandy clay loam", a.between(45, 80) & (c >= 20) & (c < 35) & (s < 27)),
        ("loam", (a <= 52) & (c >= 7)),
        ("sand", a >= 85),
        ("loamy sand", (a >= 70) & (c < 15)),
        ("sandy loam", a >= 40),
    ]
    out = F.when(~(total > 0) | total.isNull(), F.lit(None).cast("string"))
    for name, rule in rules:
        out = out.when(rule, F.lit(name))
    return out


#: Names of the texture classes in Russian (fixed values).
TEXTURE_RU = {
    "sand": "Песок",
    "loamy sand": "Супесь песчаная",
    "sandy loam": "Супесь",
    "loam": "Суглинок лёгкий",
    "silt loam": "Суглинок пылеватый",
    "silt": "Пылеватый грунт",
    "sandy clay loam": "Суглинок тяжёлый песчанистый",
    "clay loam": "Суглинок тяжёлый",
    "silty clay loam": "Суглинок тяжёлый пылеватый",
    "sandy clay": "Глина песчанистая",
    "silty clay": "Глина пылеватая",
    "clay": "Глина",
}


def soil_bins(clay: Column, silt: Column, sand: Column, step: float = 5.0) -> list[Column]:
    """The three parts in multiples of ``step`` that add up to 100: what flooring leaves goes to the largest rests.

    Up to two steps are left; of equal rests the first part (one step), or the last two (two steps), get them.
    """
    total = F.nullif(clay + silt + sand, F.lit(0.0))
    raw = [x / total * 100.0 / step for x in (clay, silt, sand)]
    base = [F.floor(r).cast("double") for r in raw]
    rest = [r - b for r, b in zip(raw, base)]
    left = F.lit(float(round(100.0 / step))) - (base[0] + base[1] + base[2])
    largest = F.when((rest[0] >= rest[1]) & (rest[0] >= rest[2]), 0).when(rest[1] >= rest[2], 1).otherwise(2)
    smallest = F.when((rest[0] <= rest[1]) & (rest[0] <= rest[2]), 0).when(rest[1] <= rest[2], 1).otherwise(2)
    return [(b + F.when((left == 1) & (largest == i), 1.0).when((left == 2) & (smallest != i), 1.0).otherwise(0.0)) * step for i, b in enumerate(base)]


#: Stems that mark the name of a dangerous industrial object (fixed values).
DANGEROUS_STEMS = "ПОЛИГОН|ЗАВОД|ТБО|ТКО|ЦЕХ|КОТЕЛЬНАЯ|РУДНИК|КАНАЛ|КАРЬЕР|СТАНЦИЯ|ПРОИЗВОД|ПРОМЫШЛЕН"


def is_dangerous_name(name: Column, stems: str = DANGEROUS_STEMS) -> Column:
    return F.coalesce(F.upper(name).rlike(stems), F.lit(False))


def joined_names(names: Column) -> Column:
    """Distinct non-null names in order, joined; null when there are none."""
    kept = F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull())))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", "))


def tile_key(name: Column) -> Column:
    """A tile's file name in canonical form: n59e30.tif and N059E030.tif are both n59e030.tif."""
    low = F.lower(name)
    parts = r"^([ns])0*(\d{1,3})([ew])0*(\d{1,3})(.*)$"
    lat, lon = F.regexp_extract(low, parts, 2), F.regexp_extract(low, parts, 4)
    built = F.concat(F.regexp_extract(low, parts, 1), lat, F.regexp_extract(low, parts, 3), F.lpad(lon, 3, "0"), F.regexp_extract(low, parts, 5))
    built = F.when(low.rlike(parts), built).otherwise(low)
    return F.when(built.rlike(r"\.tiff?$"), F.regexp_replace(built, r"\.tiff?$", ".tif")).otherwise(F.concat(built, F.lit(".tif")))


def output_name(file_name: Column, layer: str, step: float | None = None) -> Column:
    """Name of a tile's vector file: stem, layer and whole step."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.concat(stem, F.lit(f"_{layer}" + (f"_{int(step)}" if step is not None else "") + ".parquet"))

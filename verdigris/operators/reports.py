"""Texts about points and territories: what influences a point, and what a territory's mark means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import influencers
from .spatial import dealt, listed, unlisted

# Fixed output: the sentences of both texts.
SECTIONS = (
    ("source", "positive", "Источники положительного воздействия"),
    ("source", "negative", "Источники негативного воздействия"),
    ("effect", "positive", "Влияние от положительных источников"),
    ("effect", "negative", "Влияние от негативных источников"),
)
NO_INFLUENCE, NO_NAME, NO_TYPE, NO_RADIUS, NO_AREA = "Нет данных о влияющих объектах", "Нет названия", "Неизвестно", "Нет данных", "Неизвестно"
MEANINGS = {
    5.0: "Проектная территория имеет оценку 5 баллов по экологическому каркасу. Территория находится в зоне влияния объектов, оказывающих только положительное влияние на окружающую среду.",
    0.0: "Проектная территория имеет оценку 0 баллов по экологическому каркасу. Территория находится в зоне влияния объектов, оказывающих только отрицательное влияние на окружающую среду.",
    4.0: "Проектная территория имеет оценку 4 балла по экологическому каркасу. Территория находится преимущественно в зоне влияния объектов, оказывающих положительное влияние на окружающую среду.",
    3.0: "Проектная территория имеет оценку 3 балла по экологическому каркасу. Территория находится в зоне влияния как положительных, так и отрицательных объектов, однако положительное влияние оказывает большее воздействие чем отрицательное.",
    2.5: "Проектная территория имеет оценку 2.5 балла по экологическому каркасу. Территория находится в зоне влияния как положительных, так и отрицательных объектов, однако положительные и негативные влияния компенсируют друг друга.",
    2.0: "Проектная территория имеет оценку 2 балла по экологическому каркасу. Территория находится в зоне влияния как положительных, так и отрицательных объектов, однако отрицательное влияние оказывает большее воздействие чем положительное.",
    1.0: "Проектная территория имеет оценку 1 балл по экологическому каркасу. Территория находится преимущественно в зоне влияния объектов, оказывающих негативное влияние на окружающую среду.",
}


def shortened(text: Column, width: int = 70, mark: str = "...") -> Column:
    """``text`` with single spaces, cut behind its last whole word (or hyphen between words, or at a dash of several
    hyphens) that leaves room for the mark within ``width`` characters; only the mark if not even the first word fits."""
    dash = r"""(?<=[\w!"'&.,?])(?=-{2,}\w)|(?<=[\w!"'&.,?]-{2,9})(?=\w)"""
    bare = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    head = F.regexp_extract(bare, rf"(?U)^(?=.)(.{{0,{width - len(mark) - 1}}}\S)(?: |(?<=\w[^\d\W]-)(?=\w+[^\d\W])|{dash})", 1)
    return F.when(F.length(bare) <= width, bare).otherwise(F.concat(head, F.lit(mark)))


def influencer_texts(found: DataFrame, points: DataFrame, point_id: str = "point_id") -> DataFrame:
    """(point_id, report): what ``frame.influencers`` found, in sections by kind and sign; in each, by name, type and
    radius. A point without any has a sentence that says so, and so have missing names, types and radii."""
    name, kind = F.coalesce(F.col("name"), F.lit(NO_NAME)), F.coalesce(F.col("type"), F.lit(NO_TYPE))
    radius = F.coalesce(F.col("radius").cast("string"), F.lit(NO_RADIUS))
    line = F.concat(F.lit("\n• Название: "), shortened(name), F.lit("\n• Тип: "), kind, F.lit("\n• Радиус воздействия: "), radius, F.lit("\n" + "-" * 40))
    place = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("sign") == s), F.lit(i)) for i, (k, s, _) in enumerate(SECTIONS)])
    lines = found.select(point_id, place.alias("place"), F.struct("name", "type", "radius", line.alias("line")).alias("l"))
    title = F.get(F.array(*[F.lit(f"\n=== {t} ===") for _, _, t in SECTIONS]), F.col("place"))
    sections = lines.groupBy(point_id, "place").agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]).alias("lines"))
    sections = sections.select(point_id, F.struct("place", F.concat(title, F.lit("\n"), F.array_join("lines", "\n")).alias("text")).alias("s"))
    whole = sections.groupBy(point_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), "\n\n").alias("report"))
    return points.select(point_id).join(whole, point_id, "left").select(point_id, F.coalesce("report", F.lit(NO_INFLUENCE)).alias("report"))


def point_texts(sources: DataFrame, buffers: DataFrame, points: DataFrame, labels: DataFrame, cell: float, around: float = 5.0, point_id: str = "point_id") -> DataFrame:
    """(point_id, report): ``influencer_texts`` of each point. The text of a place is made once for all its points.

    Parts begin with their longest texts: a writer of Parquet takes the size of rows from those before, so it would hold
    gigabytes of long texts that come after short ones.
    """
    at = points.select(point_id, F.struct("x", "y").alias("_place"), "x", "y")
    places = at.select("_place", "x", "y").distinct()
    texts = influencer_texts(influencers(sources, buffers, places, labels, cell, around, "_place"), places, "_place")
    lists = listed(at.select("_place", point_id), ["_place"]).join(texts.hint("merge"), "_place", "left")
    told = lists.select("_place", "_n", "_rows", F.coalesce("report", F.lit(NO_INFLUENCE)).alias("report"))
    return unlisted(dealt(told, "_place", "_n").sortWithinPartitions(F.octet_length("report").desc()).drop("_place", "_n"), [point_id])


def mark_texts(marks: DataFrame, reports: DataFrame, zone_id: str = "zone_id") -> DataFrame:
    """(zone_id, text): marks (score, mean_impact, area) of zones with their meaning and the objects of
    ``frame.zone_report`` (report). A zone without a mark, of one without data, says that its area is unknown."""
    meaning = F.coalesce(*[F.when(F.col("score") == k, F.lit(v)) for k, v in MEANINGS.items()], F.lit(""))
    parts = [
        F.lit("Полная оценка территории:\n  Абсолютная оценка: "), F.regexp_replace(F.col("score").cast("string"), r"\.0$", ""), F.lit("\n  Описание объектов: "), meaning, F.lit("\n\n  Относительная оценка: "), F.col("mean_impact").cast("string"),
        F.lit("\n  Интерпретация оценки: "), F.coalesce("report", F.lit("")), F.lit("\n\n  Площадь: "), F.coalesce(F.when(F.col("area") > 0, F.col("area")).cast("string"), F.lit(NO_AREA)), F.lit("\n"),
    ]
    return marks.join(reports.select(zone_id, "report"), zone_id, "left").select(zone_id, F.concat(*parts).alias("text"))

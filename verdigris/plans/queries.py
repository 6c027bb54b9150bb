"""Every operator as a query over the fixture views, and the same rows in SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import components as C
from ..operators import frame as FR
from ..operators import overlay as O
from ..operators import raster as R
from ..operators import river as V
from ..operators.spatial import box_join, first_cover, nearest
from ..tables import shared_table
from .fixtures import fixture, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TILE = 250.0
#: Small tiles hold few edges each, so few faces: in a dense plane that is what the overlay costs.
FACE_TILE = 50.0
B = {"x0": "bx0", "y0": "by0", "x1": "bx1", "y1": "by1"}


def query(oracle: str | None = None, name: str | None = None):
    """Register a query; $6(x) in its SQL is half-even rounding to six digits."""
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLE_SQL[key] = with_views(_macros(oracle))
        return f

    return keep


def _macros(sql: str) -> str:
    for digits in (1, 2, 6):
        while (at := sql.find(f"${digits}(")) >= 0:
            depth, end = 0, at + 2
            while True:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
                if not depth:
                    break
            scale = 10**digits
            sql = f"{sql[:at]}(round_even(({sql[at + 3 : end - 1]})*{scale}.0::DOUBLE, 0)/{scale}.0::DOUBLE+0.0::DOUBLE){sql[end:]}"
    return sql


def r6(c) -> F.Column:
    return S.rint(F.col(c) if isinstance(c, str) else c, 6)


def zones_of(spark, sf) -> DataFrame:
    return fixture(spark, sf, "fx_zones").withColumnsRenamed(B)


# Scalar rules ---------------------------------------------------------------------------------------------------

_FADE = "exp(-(i-0.5)*(0.7*pow(exp(1.0::DOUBLE),2))/n)"
_DECAY = "1.0/(1.0+exp((i-0.5-n/2.0)*(10.0/n)))"


@query(f"""SELECT CAST(n AS INT) n, CAST(i AS INT) i, $6({_FADE}) positive, $6({_DECAY}) negative,
    CASE WHEN i=0 THEN 4.0 ELSE $1({_FADE}*4.0) END ring_positive, CASE WHEN i=0 THEN -10.0 ELSE $1({_DECAY}*-10.0) END ring_negative
    FROM (SELECT CAST(n AS DOUBLE) n, CAST(i AS DOUBLE) i FROM range(2, 11) a(n), range(0, 10) b(i) WHERE i < n)""")
def scalar_fading(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.range(2, 11).select(F.col("id").cast("int").alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    n, i = F.col("n").cast("double"), F.col("i").cast("double")
    return d.select("n", "i", r6(S.positive_fading(n, i)).alias("positive"), r6(S.negative_fading(n, i)).alias("negative"), S.ring_impact(F.lit(4.0), n, i).alias("ring_positive"), S.ring_impact(F.lit(-10.0), n, i).alias("ring_negative"))


@query("""SELECT source_id, $6((x1-lo)/(hi-lo)*(5.0-1.0)+1.0) v FROM fx_boxes, (SELECT min(x1) lo, max(x1) hi FROM fx_boxes)""")
def minmax_normalize(spark, sf):
    d = fixture(spark, sf, "fx_boxes")
    span = d.agg(F.min("x1").alias("lo"), F.max("x1").alias("hi"))
    return d.crossJoin(F.broadcast(span)).select("source_id", r6(S.min_max(F.col("x1"), F.col("lo"), F.col("hi"), 1.0, 5.0)).alias("v"))


_RADIUS = "$1(impact*(CASE WHEN impact>0 THEN 0.1 ELSE 0.2 END)*((sqrt((x1-x0)*(y1-y0))-sqrt(1000.0))/(sqrt(500000.0)-sqrt(1000.0))*(5.0-1.0)+1.0)*1000.0)"
_SOURCES = f"""rad AS (SELECT *, {_RADIUS} total_impact_radius FROM fx_boxes),
    span AS (SELECT min(abs(total_impact_radius)) lo, max(abs(total_impact_radius)) hi FROM rad),
    src AS (SELECT rad.*, CASE WHEN lo=hi THEN 6 ELSE greatest(2, CAST(round_even((abs(total_impact_radius)-lo)/(hi-lo)*(10.0-2.0)+2.0, 0) AS INT)) END layers_count FROM rad, span)"""


def _sources(spark, sf) -> DataFrame:
    d = fixture(spark, sf, "fx_boxes")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    fading = F.when(F.col("impact") > 0, 0.1).otherwise(0.2)
    d = d.withColumn("total_impact_radius", S.impact_radius(F.col("impact"), fading, FR.area_factor(area, (1000.0, 500000.0, 1.0, 5.0))))
    span = d.agg(F.min(F.abs("total_impact_radius")).alias("lo"), F.max(F.abs("total_impact_radius")).alias("hi"))
    return d.crossJoin(F.broadcast(span)).withColumn("layers_count", S.layer_count(F.col("total_impact_radius"), F.col("lo"), F.col("hi"))).drop("lo", "hi")


@query(f"WITH {_SOURCES} SELECT source_id, layers_count FROM src")
def layer_count(spark, sf):
    return _sources(spark, sf).select("source_id", "layers_count")


@query(f"WITH {_SOURCES} SELECT source_id, coalesce(name, 'x') || '' AS name, total_impact_radius FROM src")
def impact_radius(spark, sf):
    return _sources(spark, sf).select("source_id", S.default_name(F.col("name"), F.lit("x")).alias("name"), "total_impact_radius")


@query("""SELECT p_partkey, CASE p_size%6 WHEN 1 THEN -10 WHEN 2 THEN -8 WHEN 3 THEN -6 WHEN 4 THEN -4 ELSE -2 END impact,
    CAST(CASE p_size%6 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 WHEN 4 THEN 0.2 ELSE 0.1 END AS DOUBLE) fading FROM part""")
def danger_lookup(spark, sf):
    level = F.col("p_size") % 6
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", S.danger_impact(level).alias("impact"), S.danger_fading(level).cast("double").alias("fading"))


@query("""SELECT p_partkey FROM part WHERE regexp_matches(upper(p_name), 'RING|BOLT')""")
def keyword_filter(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").filter(S.is_dangerous_name(F.col("p_name"), "RING|BOLT")).select("p_partkey")


# Rings and overlay ----------------------------------------------------------------------------------------------

_LEVELS = """lv AS (SELECT src.*, CAST(l AS INT) AS "level", coalesce(abs(round_even(total_impact_radius/(layers_count-1), 0)), 0) w FROM src, range(0, 10) t(l) WHERE l < layers_count),
    ring AS (SELECT source_id, "level", CASE WHEN "level"=0 THEN impact ELSE $1((CASE WHEN impact>0 THEN exp(-("level"-0.5)*(0.7*pow(exp(1.0::DOUBLE),2))/layers_count) ELSE 1.0/(1.0+exp(("level"-0.5-layers_count/2.0)*(10.0/layers_count))) END)*impact) END impact,
    x0-w*"level" x0, y0-w*"level" y0, x1+w*"level" x1, y1+w*"level" y1,
    (x1-x0+2*w*"level")*(y1-y0+2*w*"level") - CASE WHEN "level"=0 THEN 0 ELSE (x1-x0+2*w*("level"-1))*(y1-y0+2*w*("level"-1)) END area FROM lv)"""


@query(f"""WITH {_SOURCES}, {_LEVELS} SELECT source_id, "level", CAST(impact AS DOUBLE) impact, x0, y0, x1, y1, area, "level"=0 is_source FROM ring""")
def donut_expand(spark, sf):
    r = O.rings(_sources(spark, sf))
    inner = F.coalesce((F.col("ix1") - F.col("ix0")) * (F.col("iy1") - F.col("iy0")), F.lit(0.0))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) - inner
    return r.select("source_id", "level", "impact", "x0", "y0", "x1", "y1", area.alias("area"), "is_source")


_COMBINE = """$1(CASE WHEN count(*)=1 THEN max(impact) ELSE
    least(sqrt(coalesce(sum(CASE WHEN impact>0 THEN impact*impact END),0)), abs(max(most)))
    - least(sqrt(coalesce(sum(CASE WHEN impact<0 THEN impact*impact END),0)), abs(min(least_))) END)"""
_FACES = """xs AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) x2 FROM (SELECT k, x0 x FROM bx UNION SELECT k, x1 FROM bx)),
    ys AS (SELECT k, y, lead(y) OVER (PARTITION BY k ORDER BY y) y2 FROM (SELECT k, y0 y FROM bx UNION SELECT k, y1 FROM bx)),
    cov AS (SELECT bx.k, x, x2, y, y2, CAST(impact AS DOUBLE) impact, is_source FROM bx JOIN xs ON bx.k=xs.k AND x>=x0 AND x2<=x1 JOIN ys ON bx.k=ys.k AND y>=y0 AND y2<=y1),
    caps AS (SELECT CAST(max(impact) AS DOUBLE) most, CAST(min(impact) AS DOUBLE) least_ FROM fx_boxes)"""
_FACE = f"face AS (SELECT k, x, x2, y, y2, {_COMBINE} layer_impact, bool_or(is_source) is_source, (x2-x)*(y2-y) area FROM cov, caps GROUP BY k, x, x2, y, y2)"
_BY_ZONE = "bx AS (SELECT zone_id k, x0, y0, x1, y1, impact, TRUE is_source FROM fx_boxes)"


@query(f"WITH {_BY_ZONE}, {_FACES}, {_FACE} SELECT layer_impact, is_source, sum(area) area FROM face GROUP BY 1, 2")
def overlay_combine(spark, sf):
    boxes = fixture(spark, sf, "fx_boxes").withColumns({"impact": F.col("impact").cast("double"), "is_source": F.lit(True)})
    return O.dissolved(O.overlay(boxes, ["zone_id"], FACE_TILE), ["layer_impact", "is_source"])


@query(f"""WITH {_BY_ZONE}, {_FACES}, face AS (SELECT x, x2, y, y2, coalesce(max(CASE WHEN impact<0 THEN impact END), max(impact)) layer_impact, (x2-x)*(y2-y) area FROM cov GROUP BY k, x, x2, y, y2)
    SELECT layer_impact, sum(area) area FROM face GROUP BY 1""")
def impact_udaf_custom(spark, sf):
    boxes = fixture(spark, sf, "fx_boxes").withColumns({"impact": F.col("impact").cast("double"), "is_source": F.lit(True)})
    return O.dissolved(O.overlay(boxes, ["zone_id"], FACE_TILE, combine=O.custom_smallest_negative, once=True), ["layer_impact"])


def _box_frame(spark, sf) -> DataFrame:
    """The overlay of all boxes, cut to zones first, so each zone is a plane of its own."""
    boxes = fixture(spark, sf, "fx_boxes").select(F.col("impact").cast("double").alias("impact"), F.lit(True).alias("is_source"), "x0", "y0", "x1", "y1")
    cut = O.clipped(box_join(boxes, zones_of(spark, sf), TILE, predicate="overlaps"), F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"))
    caps = boxes.agg(F.max("impact").alias("most"), F.min("impact").alias("least"))
    return O.overlay(cut.select("zone_id", "impact", "is_source", "x0", "y0", "x1", "y1"), ["zone_id"], FACE_TILE, caps)


_CUT = """bx AS (SELECT z.zone_id k, greatest(b.x0,z.x0) x0, greatest(b.y0,z.y0) y0, least(b.x1,z.x1) x1, least(b.y1,z.y1) y1, impact, TRUE is_source
    FROM fx_boxes b JOIN fx_zones z ON b.x0<z.x1 AND z.x0<b.x1 AND b.y0<z.y1 AND z.y0<b.y1)"""
_MARK = """mk AS (SELECT k, $2(sum(layer_impact*area)/sum(area)) mean_impact, bool_and(layer_impact>0) good, bool_and(layer_impact<0) bad, sum(area) area FROM face GROUP BY k)"""


@query(f"WITH {_CUT}, {_FACES}, {_FACE}, {_MARK} SELECT k zone_id, area, mean_impact FROM mk")
def zone_clip_area(spark, sf):
    f = _box_frame(spark, sf).withColumn("area", (F.col("fx1") - F.col("fx0")) * (F.col("fy1") - F.col("fy0")))
    return FR.marks(f).select("zone_id", "area", "mean_impact")


@query(f"""WITH {_CUT}, {_FACES}, {_FACE}, {_MARK} SELECT zone_id, coalesce(mean_impact, 0.0) mean_impact, CAST(CASE WHEN mean_impact IS NULL THEN 0.0 WHEN good THEN 5.0 WHEN bad THEN 0.0
    WHEN mean_impact>=2 THEN 4.0 WHEN mean_impact>0 THEN 3.0 WHEN mean_impact=0 THEN 2.5 WHEN mean_impact>=-4 THEN 2.0 ELSE 1.0 END AS DOUBLE) score
    FROM fx_zones LEFT JOIN mk ON k=zone_id""")
def territory_mark(spark, sf):
    f = _box_frame(spark, sf).withColumn("area", (F.col("fx1") - F.col("fx0")) * (F.col("fy1") - F.col("fy0")))
    zones = zones_of(spark, sf)
    return zones.select("zone_id").join(FR.marks(f), "zone_id", "left").select("zone_id", F.coalesce("mean_impact", F.lit(0.0)).alias("mean_impact"), F.coalesce("score", F.lit(0.0)).alias("score"))


# Spatial joins --------------------------------------------------------------------------------------------------

_HIT = "b.x0<=z.x1 AND z.x0<=b.x1 AND b.y0<=z.y1 AND z.y0<=b.y1"
_SMALL = "(SELECT source_id, zone_id home, x0, y0, x0+20 x1, y0+20 y1 FROM fx_boxes)"


def _small(spark, sf) -> DataFrame:
    return fixture(spark, sf, "fx_boxes").select("source_id", F.col("zone_id").alias("home"), "x0", "y0", (F.col("x0") + 20).alias("x1"), (F.col("y0") + 20).alias("y1"))


@query(f"SELECT source_id, zone_id FROM {_SMALL} b JOIN fx_zones z ON {_HIT}")
def sjoin_intersects_inner(spark, sf):
    return box_join(_small(spark, sf), zones_of(spark, sf), TILE).select("source_id", "zone_id")


#: The middle third of each zone, so that some sources touch none.
_FAR = "(SELECT zone_id, x0+100 x0, y0+100 y0, x1-100 x1, y1-100 y1 FROM fx_zones)"


def _far(spark, sf) -> DataFrame:
    return zones_of(spark, sf).withColumns({c: F.col(c) + s * 100 for c, s in (("bx0", 1), ("by0", 1), ("bx1", -1), ("by1", -1))})


@query(f"SELECT source_id, zone_id FROM {_SMALL} b LEFT JOIN {_FAR} z ON {_HIT}")
def sjoin_intersects_left(spark, sf):
    return box_join(_small(spark, sf), _far(spark, sf), TILE, "left", left_id="source_id").select("source_id", "zone_id")


@query(f"SELECT source_id FROM {_SMALL} b WHERE EXISTS (SELECT 1 FROM {_FAR} z WHERE {_HIT})")
def sjoin_intersects_semi(spark, sf):
    return box_join(_small(spark, sf), _far(spark, sf), TILE, "left_semi", left_id="source_id").select("source_id")


@query("SELECT point_id, source_id FROM fx_points p JOIN fx_boxes b ON p.x>=b.x0 AND p.x<=b.x1 AND p.y>=b.y0 AND p.y<=b.y1")
def sjoin_within(spark, sf):
    p = fixture(spark, sf, "fx_points").select("point_id", *[F.col(c).alias(n) for c, n in (("x", "x0"), ("y", "y0"), ("x", "x1"), ("y", "y1"))])
    b = fixture(spark, sf, "fx_boxes").withColumnsRenamed(B).select("source_id", *B.values())
    return box_join(p, b, TILE, predicate="within", copies=True).select("point_id", "source_id")


@query("SELECT point_id, min(source_id) source_id FROM fx_points p JOIN fx_boxes b ON p.x>=b.x0 AND p.x<=b.x1 AND p.y>=b.y0 AND p.y<=b.y1 GROUP BY point_id")
def sjoin_covers_first(spark, sf):
    p = fixture(spark, sf, "fx_points").select("point_id", "x", "y")
    return first_cover(p, fixture(spark, sf, "fx_boxes").withColumnsRenamed(B), TILE, "point_id", "source_id")


@query("""SELECT point_id, node, $6(dist) dist FROM (SELECT point_id, source_id node, sqrt((x-x0)*(x-x0)+(y-y0)*(y-y0)) dist,
    row_number() OVER (PARTITION BY point_id ORDER BY (x-x0)*(x-x0)+(y-y0)*(y-y0), source_id) k FROM fx_points, fx_boxes) WHERE k=1 AND dist<=100""")
def knn_nearest_node(spark, sf):
    p = fixture(spark, sf, "fx_points").select("point_id", "x", "y")
    n = fixture(spark, sf, "fx_boxes").select(F.col("source_id").alias("node"), F.col("x0").alias("nx"), F.col("y0").alias("ny"))
    return nearest(p, n, "point_id", "node").filter("dist <= 100").select("point_id", "node", r6("dist").alias("dist"))


@query("SELECT source_id FROM fx_boxes a WHERE NOT EXISTS (SELECT 1 FROM fx_boxes b WHERE b.impact=3 AND b.name=a.name)")
def name_anti_join(spark, sf):
    d = fixture(spark, sf, "fx_boxes")
    return d.join(d.filter("impact = 3").select("name"), "name", "left_anti").select("source_id")


@query("SELECT point_id FROM fx_points WHERE type IN (SELECT type FROM fx_points GROUP BY type HAVING avg(x) > (SELECT avg(x) FROM fx_points))")
def type_semi_join(spark, sf):
    d = fixture(spark, sf, "fx_points")
    mean = d.agg(F.avg("x").alias("mean"))  # one row
    east = d.groupBy("type").agg(F.avg("x").alias("x")).crossJoin(F.broadcast(mean)).filter("x > mean").select("type")
    return d.join(east, "type", "left_semi").select("point_id")


@query(f"SELECT zone_id, source_id, name, impact FROM (SELECT z.zone_id, source_id FROM {_SMALL} b JOIN fx_zones z ON {_HIT}) JOIN (SELECT source_id, name, impact FROM fx_boxes) USING (source_id)", "index_lookup")
def source_fk_join(spark, sf):
    hit = box_join(_small(spark, sf), zones_of(spark, sf), TILE).select("source_id", "zone_id")
    return hit.join(fixture(spark, sf, "fx_boxes").select("source_id", "name", "impact"), "source_id").select("zone_id", "source_id", "name", "impact")


query(f"SELECT zone_id, source_id, name, impact FROM (SELECT z.zone_id, source_id FROM {_SMALL} b JOIN fx_zones z ON {_HIT}) JOIN (SELECT source_id, name, impact FROM fx_boxes) USING (source_id)")(source_fk_join)


# Reports --------------------------------------------------------------------------------------------------------

_KIND = "CASE WHEN impact=3 THEN 'water' WHEN impact=-4 THEN 'gas_station' ELSE 'industrial' END"
_RS = f"rs AS (SELECT source_id, name, {_KIND} type, impact, abs(impact)*10.0 reach, x0, y0, x0+60 x1, y0+60 y1 FROM fx_boxes)"
_RB = "rb AS (SELECT source_id, x0-reach x0, y0-reach y0, x1+reach x1, y1+reach y1 FROM rs)"
_LB = "lb AS (SELECT * FROM (VALUES ('gas_station','АЗС'),('industrial','Supplier')) t(type, label))"


def _report_sources(spark, sf):
    kind = F.when(F.col("impact") == 3, "water").when(F.col("impact") == -4, "gas_station").otherwise("industrial")
    s = fixture(spark, sf, "fx_boxes").select("source_id", F.array("name").alias("names"), kind.alias("type"), "impact", (F.col("impact") * 10.0).alias("total_impact_radius"), "x0", "y0", (F.col("x0") + 60).alias("x1"), (F.col("y0") + 60).alias("y1"))
    reach = F.abs("total_impact_radius")
    b = s.select("source_id", (F.col("x0") - reach).alias("x0"), (F.col("y0") - reach).alias("y0"), (F.col("x1") + reach).alias("x1"), (F.col("y1") + reach).alias("y1"))
    labels = spark.createDataFrame([("gas_station", "АЗС"), ("industrial", "Supplier")], "type string, label string")
    return s, b, labels


@query(f"""WITH {_RS}, {_RB}, {_LB},
    ins AS (SELECT DISTINCT z.zone_id, name, type, label FROM rs b JOIN lb USING (type) JOIN fx_zones z ON {_HIT}),
    nea AS (SELECT DISTINCT z.zone_id, s.name, s.type, label FROM rb b JOIN rs s ON s.source_id=b.source_id JOIN lb ON lb.type=s.type JOIN fx_zones z ON {_HIT}),
    rea AS (SELECT * FROM nea WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.zone_id=nea.zone_id AND ins.name=nea.name)),
    li AS (SELECT zone_id, row_number() OVER (PARTITION BY zone_id ORDER BY name, type) n, name, label FROM ins),
    lr AS (SELECT zone_id, row_number() OVER (PARTITION BY zone_id ORDER BY name, type) n, name, label FROM rea),
    ti AS (SELECT zone_id, count(*) c, string_agg(n||'. '||CASE WHEN instr(name,label)>0 THEN name ELSE label||': "'||name||'"' END, chr(10) ORDER BY n) t FROM li GROUP BY 1),
    tr AS (SELECT zone_id, count(*) c, string_agg(n||'. '||CASE WHEN instr(name,label)>0 THEN name ELSE label||': "'||name||'"' END, chr(10) ORDER BY n) t FROM lr GROUP BY 1)
    SELECT z.zone_id, coalesce(ti.c,0) "inside", coalesce(tr.c,0) "reaching",
    CASE WHEN ti.c>0 THEN 'На проектной территории находятся '||ti.c||' источник(а/ов) негативного воздействия:'||chr(10)||ti.t ELSE chr(10)||'Источников негативного воздействия на проектной территории нет.' END ||
    CASE WHEN tr.c>0 THEN chr(10)||chr(10)||'В проектную территорию попадает влияние от '||tr.c||' источник(а/ов) негативного воздействия:'||chr(10)||tr.t ELSE '' END report
    FROM fx_zones z LEFT JOIN ti ON ti.zone_id=z.zone_id LEFT JOIN tr ON tr.zone_id=z.zone_id""")
def zone_report_text(spark, sf):
    s, b, labels = _report_sources(spark, sf)
    return FR.zone_report(s, b, zones_of(spark, sf), labels, TILE)


@query(f"""WITH {_RS}, {_RB}, {_LB}, pt AS (SELECT point_id, x-5 x0, y-5 y0, x+5 x1, y+5 y1 FROM fx_points),
    hit AS (SELECT z.point_id, source_id, 'source' kind FROM rs b JOIN pt z ON {_HIT} UNION ALL SELECT z.point_id, b.source_id, 'effect' FROM rb b JOIN pt z ON {_HIT} JOIN rs s ON s.source_id=b.source_id WHERE NOT (z.x0>=s.x0 AND z.y0>=s.y0 AND z.x1<=s.x1 AND z.y1<=s.y1))
    SELECT DISTINCT point_id, kind, CASE WHEN impact>0 THEN 'positive' ELSE 'negative' END sign, name, label type, CAST(reach AS DOUBLE) radius
    FROM hit JOIN rs USING (source_id) LEFT JOIN lb USING (type)""")
def point_influencers(spark, sf):
    s, b, labels = _report_sources(spark, sf)
    return FR.influencers(s, b, fixture(spark, sf, "fx_points"), labels, TILE)


_BASE = "bb AS (SELECT source_id, zone_id, name, impact, x0, y0, x0+30 x1, y0+30 y1 FROM fx_boxes)"


@query(f"""WITH {_BASE}, pr AS (SELECT a.source_id s, b.source_id t FROM bb a JOIN bb b ON a.zone_id=b.zone_id AND a.x0-40<=b.x1+40 AND b.x0-40<=a.x1+40 AND a.y0-40<=b.y1+40 AND b.y0-40<=a.y1+40),
    cl AS (SELECT s, t FROM pr UNION SELECT cl.s, pr.t FROM cl JOIN pr ON cl.t=pr.s), co AS (SELECT s source_id, min(t) component FROM cl GROUP BY s),
    fa AS (SELECT zone_id, component, list_sort(list(DISTINCT name)) names, CASE WHEN max(impact)<0 THEN min(impact) WHEN min(impact)>0 THEN max(impact)
    ELSE arg_max(impact, abs(impact)*2+(impact>0)::INT) END impact, count(*) n FROM bb JOIN co USING (source_id) GROUP BY zone_id, component)
    SELECT DISTINCT zone_id, CAST(component AS BIGINT) component, names, fa.impact, n, x0, y0, x1, y1 FROM bb JOIN co USING (source_id) JOIN fa USING (zone_id, component)""".replace("WITH bb", "WITH RECURSIVE bb"))
def merge_components(spark, sf):
    d = fixture(spark, sf, "fx_boxes").select("source_id", "zone_id", "name", "impact", "x0", "y0", (F.col("x0") + 30).alias("x1"), (F.col("y0") + 30).alias("y1"))
    return C.merged_by_buffer(d, 40.0, TILE, ["zone_id"])


@query(f"""WITH {_BASE}, j AS (SELECT b.source_id box_id, p.name, CAST(p.point_id%4+1 AS INT) lv FROM bb b JOIN fx_points p ON p.x>=b.x0-10 AND p.x<=b.x1+10 AND p.y>=b.y0-10 AND p.y<=b.y1+10),
    a AS (SELECT box_id, name FROM j UNION SELECT source_id, name FROM bb), n AS (SELECT box_id, string_agg(name, ', ' ORDER BY name) name FROM a GROUP BY 1)
    SELECT n.box_id, n.name, coalesce((SELECT max(lv) FROM j WHERE j.box_id=n.box_id), 4) "level" FROM n""")
def points_into_polygons(spark, sf):
    boxes = fixture(spark, sf, "fx_boxes").select(F.col("source_id").alias("box_id"), "name", "x0", "y0", (F.col("x0") + 30).alias("x1"), (F.col("y0") + 30).alias("y1"))
    points = fixture(spark, sf, "fx_points").select("name", (F.col("point_id") % 4 + 1).cast("int").alias("level"), "x", "y")
    return FR.points_into_boxes(points, boxes, 10.0, TILE)


@query("""SELECT name, impact, x0, y0, x1, y1 FROM fx_boxes WHERE impact<0 UNION SELECT name, impact, x0, y0, x1, y1 FROM fx_boxes WHERE impact>-5""")
def frame_merge_union(spark, sf):
    d = fixture(spark, sf, "fx_boxes").drop("zone_id")
    return FR.merge_sources(d.filter("impact<0"), d.filter("impact>-5")).select("name", "impact", "x0", "y0", "x1", "y1")


@query(f"WITH {_SOURCES} SELECT zone_id, impact, max(layers_count) layers_count, sum((x1-x0)*(y1-y0)) area FROM src GROUP BY 1, 2")
def dissolve_max(spark, sf):
    return _sources(spark, sf).groupBy("zone_id", "impact").agg(F.max("layers_count").alias("layers_count"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


@query("SELECT r, CAST(round_even(avg(cfvo), 0) AS INT) coarse, count(*) n FROM fx_soil GROUP BY r")
def dissolve_mean(spark, sf):
    return fixture(spark, sf, "fx_soil").groupBy("r").agg(F.rint(F.avg("cfvo")).cast("int").alias("coarse"), F.count(F.lit(1)).alias("n"))


@query("SELECT tile, $1(depth) depth, count(*) n FROM fx_flood GROUP BY 1, 2")
def dissolve_class(spark, sf):
    return fixture(spark, sf, "fx_flood").groupBy("tile", S.rint(F.col("depth"), 1).alias("depth")).agg(F.count(F.lit(1)).alias("n"))


# Rivers ---------------------------------------------------------------------------------------------------------

_PAIRS = "pairs AS (SELECT * FROM (SELECT line_id, pos, x, y, lead(x) OVER w x2, lead(y) OVER w y2 FROM fx_lines WINDOW w AS (PARTITION BY line_id ORDER BY pos)) WHERE x2 IS NOT NULL)"
_NODES = """nodes AS (SELECT x, y, row_number() OVER (ORDER BY l, p)-1 node FROM (SELECT x, y, (min({'l': line_id, 'p': pos})).l l, (min({'l': line_id, 'p': pos})).p p FROM fx_lines GROUP BY x, y))"""
_GRAPH = """gr AS (SELECT u.node src, v.node dst, min(sqrt((p.x2-p.x)*(p.x2-p.x)+(p.y2-p.y)*(p.y2-p.y))) length FROM pairs p JOIN nodes u ON u.x=p.x AND u.y=p.y JOIN nodes v ON v.x=p.x2 AND v.y=p.y2 WHERE u.node<>v.node GROUP BY 1, 2)"""


@query(f"WITH {_PAIRS} SELECT line_id, pos, x, y, x2, y2, $6(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))) length FROM pairs")
def linework_pairs(spark, sf):
    return V.vertex_pairs(fixture(spark, sf, "fx_lines")).select("line_id", F.col("pos").cast("long").alias("pos"), "x", "y", "x2", "y2", r6("length").alias("length"))


def _graph(spark, sf):
    lines = fixture(spark, sf, "fx_lines")
    nodes = V.interned(lines)
    return V.edges_of(V.vertex_pairs(lines), nodes), nodes


@query(f"WITH {_PAIRS}, {_NODES}, {_GRAPH} SELECT src, dst, $6(length) length FROM gr")
def graph_edges(spark, sf):
    edges, _ = _graph(spark, sf)
    return edges.select("src", "dst", r6("length").alias("length"))


_WIDE = "wide AS (SELECT src, dst, length, CASE WHEN src%3=0 THEN NULL ELSE 5.0+src%11 END wu, CASE WHEN dst%4=0 THEN NULL ELSE 4.0+dst%7 END wv FROM gr)"
_WIDTH = "st AS (SELECT src node, wu w FROM wide UNION ALL SELECT dst, wv FROM wide), nw AS (SELECT node, coalesce(min(w), 5.0) width FROM st GROUP BY node)"


def _wide(edges):
    return edges.select("src", "dst", F.when(F.col("src") % 3 != 0, 5.0 + F.col("src") % 11).alias("wu"), F.when(F.col("dst") % 4 != 0, 4.0 + F.col("dst") % 7).alias("wv"))


@query(f"WITH {_PAIRS}, {_NODES}, {_GRAPH}, {_WIDE}, {_WIDTH} SELECT node, CAST(width AS DOUBLE) width FROM nw")
def node_min_width(spark, sf):
    edges, _ = _graph(spark, sf)
    return V.node_widths(edges, _wide(edges))


@query(f"WITH {_PAIRS}, {_NODES}, {_GRAPH}, {_WIDE}, {_WIDTH} SELECT src, dst, CAST((a.width+b.width)/2 AS DOUBLE) width, $6(CAST((a.width+b.width)/2 AS DOUBLE)*length/50) weight FROM gr JOIN nw a ON a.node=src JOIN nw b ON b.node=dst")
def edge_weights(spark, sf):
    edges, _ = _graph(spark, sf)
    return V.weighted(edges, V.node_widths(edges, _wide(edges))).select("src", "dst", "width", r6("weight").alias("weight"))


@query(f"""WITH {_PAIRS}, an AS (SELECT *, atan2(y2-y, x2-x)+{3.141592653589793!r}/2 a FROM pairs)
    SELECT line_id, pos, $6(x-cos(a)*5.0/2) ax, $6(y-sin(a)*5.0/2) ay, $6(x+cos(a)*5.0/2) bx, $6(y+sin(a)*5.0/2) by_ FROM an""")
def cross_section_coords(spark, sf):
    p = V.vertex_pairs(fixture(spark, sf, "fx_lines"))
    ends = V.cross_section(5.0, F.col("x2") - F.col("x"), F.col("y2") - F.col("y"), F.col("x"), F.col("y"))
    return p.select("line_id", F.col("pos").cast("long").alias("pos"), *[r6(e).alias(n) for e, n in zip(ends, ("ax", "ay", "bx", "by_"))])


_CHAIN = """od AS (SELECT src node, count(*) o FROM fx_edges GROUP BY 1), idg AS (SELECT dst node, count(*) i FROM fx_edges GROUP BY 1),
    st AS (SELECT DISTINCT dst v FROM fx_edges WHERE src IN (SELECT node FROM od WHERE o>=2)),
    walk AS (SELECT v AS start, v AS node, CAST(0 AS DOUBLE) cum FROM st UNION ALL SELECT w.start, e.dst, w.cum+e.cost FROM walk w JOIN fx_edges e ON e.src=w.node
    LEFT JOIN od ON od.node=w.node LEFT JOIN idg ON idg.node=w.node WHERE coalesce(o,0)<=1 AND coalesce(i,0)<=1),
    reach AS (SELECT start, list(cum) cums FROM walk GROUP BY start)"""


@query(f"WITH RECURSIVE {_CHAIN} SELECT start, $6(list_avg([c for c in cums if c<=20])) mean FROM reach")
def chain_average(spark, sf):
    return V.chain_average(V.chains(fixture(spark, sf, "fx_edges")), 20.0).select("start", r6("mean").alias("mean"))


_SPILL = f"""{_CHAIN}, kid AS (SELECT e.src, e.dst, e.cost, coalesce(r.cums, [CAST(0 AS DOUBLE)]) cums, o FROM fx_edges e JOIN od ON od.node=e.src LEFT JOIN reach r ON r.start=e.dst),
    kids AS (SELECT k.*, sib FROM kid k JOIN (SELECT src, list(cums) sib FROM kid GROUP BY src) USING (src)),
    sp AS (SELECT source_id, CAST(node AS BIGINT) node, pollution r FROM fx_spill_sources UNION ALL
    SELECT * FROM (SELECT s.source_id, k.dst, CASE WHEN k.o=1 THEN s.r ELSE s.r*list_avg([c for c in k.cums if c<=s.r])/nullif(list_sum([list_avg([c for c in q if c<=s.r]) for q in k.sib]),0) END - k.cost r
    FROM sp s JOIN kids k ON k.src=s.node) WHERE r>=0),
    tot AS (SELECT node, sum(r) remain FROM sp GROUP BY node)"""


def _spill(spark, sf):
    return V.spilled(fixture(spark, sf, "fx_edges"), fixture(spark, sf, "fx_spill_sources"))


@query(f"WITH RECURSIVE {_SPILL} SELECT node, $6(remain) remain FROM tot")
def spill_propagation(spark, sf):
    return _spill(spark, sf).select("node", r6("remain").alias("remain"))


@query(f"WITH RECURSIVE {_SPILL} SELECT src, dst, $6((a.remain+b.remain)/2) remain FROM fx_edges JOIN tot a ON a.node=src JOIN tot b ON b.node=dst")
def edge_remain(spark, sf):
    nodes = shared_table(_spill(spark, sf), "remain")
    return V.edge_remain(fixture(spark, sf, "fx_edges"), nodes).select("src", "dst", r6("remain").alias("remain"))


_SPOTS = """np AS (SELECT node, CAST((node*7919)%1350 AS DOUBLE) x, CAST((node*104729)%1350 AS DOUBLE) y FROM (SELECT src node FROM fx_edges UNION SELECT dst FROM fx_edges)),
    near AS (SELECT source_id, node, pollution FROM (SELECT b.source_id, n.node, 60.0::DOUBLE+b.source_id%50 pollution, sqrt((b.x0-n.x)*(b.x0-n.x)+(b.y0-n.y)*(b.y0-n.y)) d,
    row_number() OVER (PARTITION BY b.source_id ORDER BY (b.x0-n.x)*(b.x0-n.x)+(b.y0-n.y)*(b.y0-n.y), n.node) k FROM fx_boxes b, np n) WHERE k=1 AND d<=60)"""


@query(f"""WITH RECURSIVE {_SPOTS}, {_SPILL.replace("FROM fx_spill_sources UNION", "FROM near UNION")}
    SELECT e.src, e.dst, $6(coalesce((a.remain+b.remain)/2, 0)) remain FROM (SELECT DISTINCT src, dst FROM fx_edges) e LEFT JOIN tot a ON a.node=e.src LEFT JOIN tot b ON b.node=e.dst""")
def simulated_spill(spark, sf):
    edges = fixture(spark, sf, "fx_edges")
    nodes = edges.selectExpr("explode(array(src, dst)) AS node").distinct()
    nodes = nodes.withColumns({"x": (F.col("node") * 7919 % 1350).cast("double"), "y": (F.col("node") * 104729 % 1350).cast("double")})
    sources = fixture(spark, sf, "fx_boxes").select("source_id", F.col("x0").alias("x"), F.col("y0").alias("y"), (60.0 + F.col("source_id") % 50).alias("pollution"))
    return V.simulate_spill(edges, nodes, sources, 60.0, only_polluted=False).select("src", "dst", r6("remain").alias("remain"))


@query("SELECT user_id, $6(coalesce(avg(CASE WHEN value>0 THEN value END), 0)) mean FROM events GROUP BY user_id")
def conditional_mean(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(r6(V.conditional_mean(F.col("value"))).alias("mean"))


# Rasters --------------------------------------------------------------------------------------------------------


@query("""SELECT tile, "row", "col", value, 100.0::DOUBLE+"col"*10.0::DOUBLE x, 900.0::DOUBLE-"row"*10.0::DOUBLE y FROM fx_raster WHERE "row" BETWEEN 10 AND 24 AND "col" BETWEEN 5 AND 20""")
def raster_window(spark, sf):
    d = R.window(fixture(spark, sf, "fx_raster"), (155.0, 655.0, 305.0, 800.0), 100.0, 900.0, 10.0)
    x, y = R.pixel_place(F.col("row"), F.col("col"), 100.0, 900.0, 10.0)
    return d.select("tile", "row", "col", "value", x.alias("x"), y.alias("y"))


@query("""WITH s AS (SELECT tile, CAST(floor(min(value)/25) AS BIGINT) lo, CAST(ceil(max(value)/25) AS BIGINT) hi FROM fx_raster GROUP BY 1),
    g AS (SELECT tile, unnest(range(lo, hi+1))*25.0::DOUBLE AS "level" FROM s), c AS (SELECT tile, round_even(value/25, 0)*25.0::DOUBLE AS "level", count(*) n FROM fx_raster GROUP BY 1, 2)
    SELECT g.tile, g."level", coalesce(n, 0) n FROM g LEFT JOIN c ON g.tile=c.tile AND g."level"=c."level" """)
def quantize_levels(spark, sf):
    return R.levels(fixture(spark, sf, "fx_raster"), 25.0)


_GRAD = """sp AS (SELECT tile, min("row") lr, max("row") hr, min("col") lc, max("col") hc FROM fx_raster GROUP BY 1),
    g AS (SELECT tile, lr, hr, lc, hc, r, unnest(range(lc, hc+1)) c FROM (SELECT *, unnest(range(lr, hr+1)) r FROM sp)),
    f AS (SELECT g.*, v.value v, lag(v.value) OVER a bx, lead(v.value) OVER a ax, lag(v.value) OVER b by_, lead(v.value) OVER b ay FROM g LEFT JOIN fx_raster v ON v.tile=g.tile AND v."row"=g.r AND v."col"=g.c
    WINDOW a AS (PARTITION BY g.tile, r ORDER BY c), b AS (PARTITION BY g.tile, c ORDER BY r)),
    gd AS (SELECT tile, CAST(r AS INT) AS "row", CAST(c AS INT) AS "col", CASE WHEN c=lc THEN (ax-v)/30.0::DOUBLE WHEN c=hc THEN (v-bx)/30.0::DOUBLE ELSE (ax-bx)/60.0::DOUBLE END gx, CASE WHEN r=lr THEN (ay-v)/30.0::DOUBLE WHEN r=hr THEN (v-by_)/30.0::DOUBLE ELSE (ay-by_)/60.0::DOUBLE END gy FROM f)"""


@query(f"""WITH {_GRAD}, s AS (SELECT *, degrees(atan(sqrt(gx*gx+gy*gy))) d FROM gd) SELECT tile, "row", "col", $6(d) slope, CASE WHEN round_even(d/5, 0)*5>=5 THEN round_even(d/5, 0)*5.0::DOUBLE END class FROM s""")
def terrain_slope(spark, sf):
    g = R.gradient(fixture(spark, sf, "fx_raster"), 30.0, 30.0).withColumn("d", S.slope(F.col("gx"), F.col("gy")))
    c = S.quantise(F.col("d"), 5.0)
    return g.select("tile", "row", "col", r6("d").alias("slope"), F.when(c >= 5, c).alias("class"))


@query(f"""WITH {_GRAD}, s AS (SELECT *, CASE WHEN sqrt(gx*gx+gy*gy)>=1e-9 THEN fmod(degrees(atan2(-gx, gy))+360.0, 360.0) END d FROM gd)
    SELECT tile, "row", "col", $6(d) aspect, CASE WHEN d IS NULL THEN '' ELSE ['N','NE','E','SE','S','SW','W','NW'][CAST(round_even(d/45.0, 0) AS INT)%8+1] END label FROM s""")
def terrain_aspect(spark, sf):
    g = R.gradient(fixture(spark, sf, "fx_raster"), 30.0, 30.0).withColumn("d", S.aspect(F.col("gx"), F.col("gy")))
    return g.select("tile", "row", "col", r6("d").alias("aspect"), S.aspect_label(F.col("d"), 45.0).alias("label"))


_ZONAL = """SELECT tile, zone_id, value, n FROM (SELECT *, row_number() OVER (PARTITION BY tile, zone_id ORDER BY n DESC, value) k FROM
    (SELECT tile, zone_id, value, count(*) n FROM fx_raster v JOIN {zones} z ON "col"*45.0>=z.x0 AND "col"*45.0<=z.x1 AND "row"*45.0>=z.y0 AND "row"*45.0<=z.y1 GROUP BY 1,2,3)) WHERE k=1"""


@query(_ZONAL.format(zones="fx_zones"))
def zonal_mode(spark, sf):
    d = fixture(spark, sf, "fx_raster").withColumns({"x": F.col("col") * 45.0, "y": F.col("row") * 45.0})
    return R.zonal_mode(d, zones_of(spark, sf), TILE)


#: A corner of each zone, some smaller than a pixel and some beyond the raster.
_TINY = "(SELECT zone_id, x0*1.2+7 x0, y0*1.2+11 y0, x0*1.2+7+(zone_id%4)*15.0 x1, y0*1.2+11+(zone_id%4)*15.0 y1 FROM fx_zones)"
_GROWN, _MIDDLE = "(SELECT zone_id, x0-45*sqrt(2.0::DOUBLE)/2 x0, y0-45*sqrt(2.0::DOUBLE)/2 y0, x1+45*sqrt(2.0::DOUBLE)/2 x1, y1+45*sqrt(2.0::DOUBLE)/2 y1 FROM tiny)", "(SELECT zone_id, (x0+x1)/2-45 x0, (y0+y1)/2 y0, (x0+x1)/2 x1, (y0+y1)/2+45 y1 FROM tiny)"


@query(f"""WITH tiny AS {_TINY}, a AS ({_ZONAL.format(zones="tiny")}), b AS ({_ZONAL.format(zones=_GROWN)}), c AS ({_ZONAL.format(zones=_MIDDLE)}), ts AS (SELECT DISTINCT tile FROM fx_raster)
    , ex AS (SELECT tile, min("col")*45.0 x0, min("row")*45.0-45 y0, max("col")*45.0+45 x1, max("row")*45.0 y1 FROM fx_raster GROUP BY 1),
    every AS (SELECT ts.tile, tiny.zone_id, coalesce(a.value, b.value, c.value) value, coalesce(a.n, b.n, c.n, 0) n FROM ts CROSS JOIN tiny LEFT JOIN a ON a.tile=ts.tile AND a.zone_id=tiny.zone_id
    LEFT JOIN b ON b.tile=ts.tile AND b.zone_id=tiny.zone_id LEFT JOIN c ON c.tile=ts.tile AND c.zone_id=tiny.zone_id),
    hit AS (SELECT e.* FROM every e JOIN {_GROWN} b USING (zone_id) JOIN ex z ON z.tile=e.tile WHERE value IS NOT NULL OR ({_HIT}))
    SELECT * FROM hit UNION ALL SELECT NULL, zone_id, NULL, 0 FROM tiny WHERE zone_id NOT IN (SELECT zone_id FROM hit)""")
def zonal_mode_small_zones(spark, sf):
    d = fixture(spark, sf, "fx_raster").withColumns({"x": F.col("col") * 45.0, "y": F.col("row") * 45.0})
    side = (F.col("zone_id") % 4) * 15.0
    z = fixture(spark, sf, "fx_zones").select("zone_id", (F.col("x0") * 1.2 + 7).alias("bx0"), (F.col("y0") * 1.2 + 11).alias("by0"))
    return R.zonal_mode(d, z.withColumns({"bx1": F.col("bx0") + side, "by1": F.col("by0") + side}), TILE, 45.0)


def _gauss_sql() -> str:
    w = ",".join(f"({d},{x!r}::DOUBLE)" for d, x in zip(range(-4, 5), R.gaussian_kernel(1.0).tolist()))
    return f"""WITH sp AS (SELECT tile, min("row") lr, max("row") hr, min("col") lc, max("col") hc FROM fx_raster GROUP BY 1),
    g AS (SELECT tile, lr, hr, lc, hc, r, unnest(range(lc, hc+1)) c FROM (SELECT *, unnest(range(lr, hr+1)) r FROM sp)),
    f AS (SELECT g.*, v.value FROM g LEFT JOIN fx_raster v ON v.tile=g.tile AND v."row"=g.r AND v."col"=g.c), w(d, k) AS (VALUES {w}),
    a AS (SELECT v.tile, v.r, v.c, v.lc, v.hc, CASE WHEN count(u.value)=9 THEN sum(k*u.value) END av FROM f v CROSS JOIN w JOIN f u ON u.tile=v.tile AND u.c=v.c AND u.r=greatest(v.lr, least(v.hr, v.r+d)) GROUP BY 1,2,3,4,5)
    SELECT a.tile, CAST(a.r AS INT) AS "row", CAST(a.c AS INT) AS "col", $6(CASE WHEN count(u.av)=9 THEN sum(k*u.av) END) value FROM a CROSS JOIN w JOIN a u ON u.tile=a.tile AND u.r=a.r AND u.c=greatest(a.lc, least(a.hc, a.c+d)) GROUP BY 1,2,3"""


@query(_gauss_sql())
def gaussian_smooth(spark, sf):
    return R.smoothed(fixture(spark, sf, "fx_raster"), 1.0).select("tile", "row", "col", r6("value").alias("value"))


def _circle_sql() -> str:
    w = ",".join(f"({d},{x!r}::DOUBLE)" for d, x in zip(range(-4, 5), R.gaussian_kernel(1.0).tolist()))
    sums = ", ".join(f"sum(k*u.{n}) {n}" for n in "csw")
    return f"""WITH {_GRAD}, di AS (SELECT tile, "row" r, "col" c_, CASE WHEN sqrt(gx*gx+gy*gy)>=1e-9 THEN radians(fmod(degrees(atan2(-gx, gy))+360.0, 360.0)) END a FROM gd),
    t AS (SELECT tile, r, c_, coalesce(cos(a), 0) c, coalesce(sin(a), 0) s, CASE WHEN a IS NULL THEN 0.0 ELSE 1.0::DOUBLE END w FROM di), w(d, k) AS (VALUES {w}),
    e AS (SELECT tile, min(r) lr, max(r) hr, min(c_) lc, max(c_) hc FROM t GROUP BY 1),
    x AS (SELECT v.tile, v.r, v.c_, {sums} FROM t v JOIN e ON e.tile=v.tile CROSS JOIN w JOIN t u ON u.tile=v.tile AND u.c_=v.c_ AND u.r=greatest(lr, least(hr, v.r+d)) GROUP BY 1, 2, 3),
    y AS (SELECT v.tile, v.r, v.c_, {sums} FROM x v JOIN e ON e.tile=v.tile CROSS JOIN w JOIN x u ON u.tile=v.tile AND u.r=v.r AND u.c_=greatest(lc, least(hc, v.c_+d)) GROUP BY 1, 2, 3)
    SELECT tile, CAST(r AS INT) AS "row", CAST(c_ AS INT) AS "col", $6(CASE WHEN w>=1e-12 THEN fmod(degrees(atan2(s, c))+360.0, 360.0) END) value FROM y"""


@query(_circle_sql())
def circular_smooth(spark, sf):
    g = R.gradient(fixture(spark, sf, "fx_raster"), 30.0, 30.0).withColumn("value", S.aspect(F.col("gx"), F.col("gy")))
    return R.smoothed_directions(g, 1.0).select("tile", "row", "col", r6("value").alias("value"))


_PCT = "pc AS (SELECT px, r, c, cfvo, clay/(clay+silt+sand)*100.0::DOUBLE cl, silt/(clay+silt+sand)*100.0::DOUBLE si, sand/(clay+silt+sand)*100.0::DOUBLE sa FROM fx_soil)"
_TEXTURE = """CASE WHEN cl>=40 AND si<=40 AND sa<=45 THEN 'clay' WHEN sa>=45 AND cl>=35 AND cl<55 THEN 'sandy clay' WHEN si>=40 AND cl>=40 AND sa<=20 THEN 'silty clay'
    WHEN si>=40 AND si<=73 AND cl>=27 AND cl<40 AND sa<=20 THEN 'silty clay loam' WHEN cl>=27 AND cl<40 AND sa>=20 AND sa<=45 THEN 'clay loam' WHEN si>=80 AND cl<=12 AND sa<=20 THEN 'silt'
    WHEN si>=50 AND cl<=27 THEN 'silt loam' WHEN sa>=45 AND sa<=80 AND cl>=20 AND cl<35 AND si<27 THEN 'sandy clay loam' WHEN sa<=52 AND cl>=7 THEN 'loam' WHEN sa>=85 THEN 'sand'
    WHEN sa>=70 AND cl<15 THEN 'loamy sand' WHEN sa>=40 THEN 'sandy loam' END"""
_RU = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.TEXTURE_RU.items()) + " END"


@query(f"WITH {_PCT} SELECT px, t texture, {_RU} texture_ru FROM (SELECT px, {_TEXTURE} t FROM pc)")
def soil_texture(spark, sf):
    t = S.soil_texture(F.col("clay"), F.col("silt"), F.col("sand"))
    return fixture(spark, sf, "fx_soil").select("px", t.alias("texture")).withColumn("texture_ru", S.lookup(F.col("texture"), S.TEXTURE_RU).cast("string"))


_BINS = f"""{_PCT}, rw AS (SELECT px, cfvo, cl/5 a, si/5 b, sa/5 d FROM pc), rs AS (SELECT px, cfvo, floor(a) fa, floor(b) fb, floor(d) fd, a-floor(a) ra, b-floor(b) rb, d-floor(d) rd, 20-(floor(a)+floor(b)+floor(d)) lf FROM rw),
    bn AS (SELECT px, cfvo, (fa+CASE WHEN lf=1 AND ra>=rb AND ra>=rd THEN 1 WHEN lf=2 AND NOT (ra<=rb AND ra<=rd) THEN 1 ELSE 0 END)*5.0::DOUBLE clay_pct,
    (fb+CASE WHEN lf=1 AND NOT (ra>=rb AND ra>=rd) AND rb>=rd THEN 1 WHEN lf=2 AND NOT (NOT (ra<=rb AND ra<=rd) AND rb<=rd) THEN 1 ELSE 0 END)*5.0::DOUBLE silt_pct,
    (fd+CASE WHEN lf=1 AND NOT (ra>=rb AND ra>=rd) AND NOT rb>=rd THEN 1 WHEN lf=2 AND ((ra<=rb AND ra<=rd) OR rb<=rd) THEN 1 ELSE 0 END)*5.0::DOUBLE sand_pct FROM rs)"""


def _bins(spark, sf):
    b = S.soil_bins(F.col("clay"), F.col("silt"), F.col("sand"))
    return fixture(spark, sf, "fx_soil").select("px", "cfvo", *[x.alias(n) for x, n in zip(b, ("clay_pct", "silt_pct", "sand_pct"))])


@query(f"WITH {_BINS} SELECT px, clay_pct, silt_pct, sand_pct FROM bn")
def soil_bins(spark, sf):
    return _bins(spark, sf).drop("cfvo")


@query(f"""WITH {_BINS}, tx AS (SELECT *, clay_pct/(clay_pct+silt_pct+sand_pct)*100.0::DOUBLE cl, silt_pct/(clay_pct+silt_pct+sand_pct)*100.0::DOUBLE si, sand_pct/(clay_pct+silt_pct+sand_pct)*100.0::DOUBLE sa FROM bn)
    SELECT clay_pct, silt_pct, sand_pct, usda_texture, CAST(round_even(avg(cfvo), 0) AS INT) coarse, count(*) n FROM (SELECT *, {_TEXTURE} usda_texture FROM tx) GROUP BY 1,2,3,4""")
def soil_dissolve(spark, sf):
    from ..operators import vectorise

    return vectorise.soil_areas(vectorise.soil_classes(fixture(spark, sf, "fx_soil")))


@query("SELECT tile, depth_m, count(*) n, min(r) top, max(r) bottom FROM (SELECT tile, r, c, $1(round_even(depth/0.2::DOUBLE, 0)*0.2::DOUBLE) depth_m FROM fx_flood WHERE depth>0) GROUP BY 1, 2")
def flood_depth(spark, sf):
    from ..operators import vectorise

    d = vectorise.flood_classes(fixture(spark, sf, "fx_flood").withColumnRenamed("depth", "value"), 0.2)
    return d.groupBy("tile", "depth_m").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("top"), F.max("r").alias("bottom"))


# Files and jobs -------------------------------------------------------------------------------------------------

_KEY = r"""CASE WHEN regexp_matches(lower(file_name), '^([ns])0*(\d{1,3})([ew])0*(\d{1,3})(.*)$') THEN regexp_extract(lower(file_name), '^([ns])0*(\d{1,3})([ew])0*(\d{1,3})(.*)$', 1)
    || regexp_extract(lower(file_name), '^([ns])0*(\d{1,3})([ew])0*(\d{1,3})(.*)$', 2) || regexp_extract(lower(file_name), '^([ns])0*(\d{1,3})([ew])0*(\d{1,3})(.*)$', 3)
    || lpad(regexp_extract(lower(file_name), '^([ns])0*(\d{1,3})([ew])0*(\d{1,3})(.*)$', 4), 3, '0') || regexp_extract(lower(file_name), '^([ns])0*(\d{1,3})([ew])0*(\d{1,3})(.*)$', 5) ELSE lower(file_name) END"""
_NAME = f"CASE WHEN regexp_matches(k, '\\.tiff?$') THEN regexp_replace(k, '\\.tiff?$', '.tif') ELSE k||'.tif' END"


@query(f"SELECT tile_id, {_NAME} tile_key, regexp_replace({_NAME}, '\\.[^.]*$', '')||'_slope_2.parquet' output FROM (SELECT tile_id, {_KEY} k FROM fx_tiles)")
def tile_name_normalize(spark, sf):
    d = fixture(spark, sf, "fx_tiles").withColumn("tile_key", S.tile_key(F.col("file_name")))
    return d.select("tile_id", "tile_key", S.output_name(F.col("tile_key"), "slope", 2.0).alias("output"))


@query("""SELECT tile_id, layer FROM (SELECT tile_id FROM fx_tiles), (VALUES ('height'),('slope'),('aspect')) l(layer) WHERE NOT (tile_id%2=0 AND layer='slope') AND tile_id%5<>0""")
def resume_anti_join(spark, sf):
    from ..streaming.tiles import pending

    tiles = fixture(spark, sf, "fx_tiles").select("tile_id")
    done = tiles.filter("tile_id%2=0").select("tile_id", F.lit("slope").alias("layer")).union(tiles.filter("tile_id%5=0").select("tile_id", F.explode(F.array(*map(F.lit, ("height", "slope", "aspect")))).alias("layer")))
    return pending(tiles, ["height", "slope", "aspect"], done, "tile_id")


# Shapes that aren't boxes ---------------------------------------------------------------------------------------


@query("SELECT source_id, z.zone_id, $6((least(b.x1,z.x1)-greatest(b.x0,z.x0))*(least(b.y1,z.y1)-greatest(b.y0,z.y0))) area FROM fx_boxes b JOIN fx_zones z ON b.x0<z.x1 AND z.x0<b.x1 AND b.y0<z.y1 AND z.y0<b.y1")
def polygon_overlay(spark, sf):
    from ..functions import shapes

    pairs = shapes.spread(box_join(fixture(spark, sf, "fx_boxes").drop("zone_id"), zones_of(spark, sf), TILE, predicate="overlaps"))
    a, b = (shapes.box(*map(F.col, c)) for c in (("x0", "y0", "x1", "y1"), ("bx0", "by0", "bx1", "by1")))
    pairs = pairs.select("source_id", "zone_id", a.alias("a"), b.alias("b"))
    return pairs.select("source_id", "zone_id", shapes.intersection(F.col("a"), F.col("b")).alias("g")).select("source_id", "zone_id", r6(shapes.area(F.col("g"))).alias("area"))


@query()
def buffer_area(spark, sf):
    from ..functions import shapes

    d = shapes.spread(fixture(spark, sf, "fx_boxes")).select("source_id", shapes.box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("g"))
    wide = d.select("source_id", shapes.area(F.col("g")).alias("area"), shapes.buffer(F.col("g"), 25.0).alias("w"), shapes.buffer(F.col("g"), -25.0).alias("n"))
    return wide.select("source_id", "area", S.rint(shapes.area(F.col("w")), 1).alias("wider"), S.rint(shapes.area(F.col("n")), 1).alias("narrower"))


@query("SELECT point_id, $6(30.0+x/300.0) lon, $6(y/20.0) lat FROM fx_points")
def utm_roundtrip(spark, sf):
    from ..functions import shapes

    @F.pandas_udf("binary")
    def point(lon, lat):
        import numpy as np
        import pandas as pd

        from ..geometry import wkb

        return pd.Series([wkb.dumps(wkb.POINT, [np.array([[a, b]])]) for a, b in zip(lon, lat)])

    d = shapes.spread(fixture(spark, sf, "fx_points")).select("point_id", point(30.0 + F.col("x") / 300.0, F.col("y") / 20.0).alias("g"))
    back = d.select("point_id", shapes.reproject(shapes.reproject(F.col("g"), 4326, 32636), 32636, 4326).alias("g"))
    b = shapes.with_bounds(back, "g")
    return b.select("point_id", r6("x0").alias("lon"), r6("y0").alias("lat"))


@query()
def contour_lines(spark, sf):
    from ..functions import shapes
    from ..operators import vectorise

    d = R.gradient(fixture(spark, sf, "fx_raster"), 30.0, 30.0)  # missing cells are filled in
    span = d.groupBy("tile").agg((F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"), F.array_sort(F.collect_list(F.struct("row", "col", F.struct("value").alias("v")))).alias("p"))
    tiles = span.select("tile", F.lit(0.0).alias("x_min"), F.lit(960.0).alias("y_max"), F.lit(30.0).alias("size_x"), F.lit(30.0).alias("size_y"), "height", "width", F.transform("p", lambda p: p["v"]["value"]).alias("values"), F.lit(None).cast("string").alias("error"))
    lines = vectorise.height_isolines(tiles, 100.0)
    return lines.groupBy("tile", F.col("value").alias("level")).agg(F.count(F.lit(1)).alias("lines"), r6(F.sum(shapes.length(F.col("geom")))).alias("length"))

"""Queries of whole jobs: prepared layers and frames, river networks from lines and water, regions of pixels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import coordinates as K
from ..functions import scalars as S
from ..functions import shapes
from ..functions.sql import register
from ..geometry.projection import _ALPHA, _N, _R
from ..operators import components as C
from ..operators import frame as FR
from ..operators import regions as G
from ..operators import reports as T
from ..operators import river as V
from ..operators import vectorise as P
from ..sources import geoparquet
from ..sources.rasters import tile_ids
from ..tables import shared_dir
from .fixtures import fixture
from .queries import _GRAD, _HIT, _LB, _PAIRS, _RB, _RS, _TEXTURE, ORACLE_SQL, QUERIES, TILE, _BINS, _report_sources, query, r6, zones_of

__all__ = ["ORACLE_SQL", "QUERIES"]

# Layers and frames ----------------------------------------------------------------------------------------------

_DANGER = """dg AS (SELECT source_id, name, x0, y0, x0+30 x1, y0+30 y1, CASE source_id%6 WHEN 1 THEN -10 WHEN 2 THEN -8 WHEN 3 THEN -6 WHEN 4 THEN -4 ELSE -2 END impact,
    CAST(CASE source_id%6 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 WHEN 4 THEN 0.2 ELSE 0.1 END AS DOUBLE) fading FROM fx_boxes)"""


def _dangerous(spark, sf):
    return fixture(spark, sf, "fx_boxes").select("source_id", "name", (F.col("source_id") % 6).alias("dangerous_level"), "x0", "y0", (F.col("x0") + 30).alias("x1"), (F.col("y0") + 30).alias("y1"))


@query(f"""WITH RECURSIVE {_DANGER}, pr AS (SELECT a.source_id s, b.source_id t FROM dg a JOIN dg b ON a.x0-10<=b.x1+10 AND b.x0-10<=a.x1+10 AND a.y0-10<=b.y1+10 AND b.y0-10<=a.y1+10),
    cl AS (SELECT s, t FROM pr UNION SELECT cl.s, pr.t FROM cl JOIN pr ON cl.t=pr.s), co AS (SELECT s source_id, min(t) component FROM cl GROUP BY s),
    fa AS (SELECT component, list_sort(list(DISTINCT name)) names, min(impact) impact, min($1(impact*fading*1000.0)) total_impact_radius FROM dg JOIN co USING (source_id) GROUP BY component)
    SELECT DISTINCT CAST(component AS BIGINT) source_id, names, 'industrial' type, CAST(fa.impact AS DOUBLE) impact, total_impact_radius, x0, y0, x1, y1 FROM dg JOIN co USING (source_id) JOIN fa USING (component)""")
def prepared_layer(spark, sf):
    """Objects of a layer that merge: each has a radius before, and the strongest counts."""
    return FR.prepare_layer(_dangerous(spark, sf), "industrial", FR.RULES["industrial"], TILE).drop("make_rings")


@query("""WITH g AS (SELECT i, j FROM range(-10, 160) a(i), range(-10, 160) b(j)),
    full_ AS (SELECT DISTINCT i, j FROM g JOIN fx_woods ON x0-50<=i*10 AND i*10+10<=x1+50 AND y0-50<=j*10 AND j*10+10<=y1+50),
    near AS (SELECT f.i, f.j FROM full_ f JOIN full_ o ON o.i BETWEEN f.i-5 AND f.i+5 AND o.j BETWEEN f.j-5 AND f.j+5 GROUP BY 1, 2 HAVING count(*)=121)
    SELECT CAST(floor(i/25.0) AS BIGINT) cx, CAST(floor(j/25.0) AS BIGINT) cy, count(*)*100.0::DOUBLE area FROM near GROUP BY 1, 2""")
def closed_union(spark, sf):
    """Boxes united and closed over tiles, against a grid of cells."""
    d = G.closed(fixture(spark, sf, "fx_woods"), 50.0, 250.0)
    return d.groupBy("cx", "cy").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


_FEW = """rad AS (SELECT source_id, impact, $1(impact*0.02::DOUBLE*1000.0) total_impact_radius, x0, y0, x0+90 x1, y0+70 y1 FROM fx_boxes),
    span AS (SELECT CAST(trunc(min(abs(total_impact_radius))) AS DOUBLE) lo, CAST(trunc(max(abs(total_impact_radius))) AS DOUBLE) hi FROM rad),
    src AS (SELECT rad.*, CASE WHEN lo=hi THEN CAST(round_even((2+4)/2.0, 0) AS INT) ELSE greatest(2, CAST(round_even((abs(total_impact_radius)-lo)/(hi-lo)*(4.0-2.0)+2.0, 0) AS INT)) END layers_count FROM rad, span)"""
_RINGS = """lv AS (SELECT src.*, CAST(l AS INT) AS "level", coalesce(abs(round_even(total_impact_radius/(layers_count-1), 0)), 0) w FROM src, range(0, 4) t(l) WHERE l < layers_count),
    bx AS (SELECT impact k, "level", {impact} impact, "level"=0 is_source, x0-w*"level" x0, y0-w*"level" y0, x1+w*"level" x1, y1+w*"level" y1 FROM lv)"""
_OWN = "CASE WHEN \"level\"=0 THEN impact ELSE impact/(1.0+\"level\") END"
_PLANE = """xs AS (SELECT x, lead(x) OVER (ORDER BY x) x2 FROM (SELECT x0 x FROM bx UNION SELECT x1 FROM bx)), ys AS (SELECT y, lead(y) OVER (ORDER BY y) y2 FROM (SELECT y0 y FROM bx UNION SELECT y1 FROM bx)),
    cov AS (SELECT k, x, x2, y, y2, arg_min(impact, "level") impact, arg_min(is_source, "level") is_source FROM bx JOIN xs ON x>=x0 AND x2<=x1 JOIN ys ON y>=y0 AND y2<=y1 GROUP BY k, x, x2, y, y2),
    face AS (SELECT x, x2, y, y2, $1(CASE WHEN count(*)=1 THEN max(impact) ELSE least(sqrt(coalesce(sum(CASE WHEN impact>0 THEN impact*impact END),0)), abs((SELECT max(impact) FROM bx)))
    - least(sqrt(coalesce(sum(CASE WHEN impact<0 THEN impact*impact END),0)), abs((SELECT min(impact) FROM bx))) END) layer_impact, bool_or(is_source) is_source FROM cov GROUP BY x, x2, y, y2)"""


def _halved(impact, layers, level):
    return F.when(level == 0, impact).otherwise(impact / (1.0 + level))


def _few(spark, sf):
    d = fixture(spark, sf, "fx_boxes").select("source_id", "name", "impact", "x0", "y0", (F.col("x0") + 90).alias("x1"), (F.col("y0") + 70).alias("y1"))
    rule = FR.LayerRule(("impact", lambda c: c), 0.02, "x")
    return {"good": d.filter("impact > 0"), "bad": d.filter("impact < 0"), "none": None}, {k: rule for k in ("good", "bad", "none")}


@query(f"WITH {_FEW}, {_RINGS.format(impact=_OWN)}, {_PLANE} SELECT layer_impact, is_source, $6(sum((x2-x)*(y2-y))) area FROM face GROUP BY 1, 2")
def frame_map(spark, sf):
    """A frame from its layers, with a fading of one's own, in regions of equal impact; sources of equal type, impact and
    radius are one shape."""
    layers, rules = _few(spark, sf)
    built = FR.build_frame(layers, rules, least_layers=2, most_layers=4, tile=100.0, fading=_halved)
    facts = G.region_facts(FR.dissolved_map(built), ["layer_impact", "is_source"])
    return facts.groupBy("layer_impact", "is_source").agg(r6(F.sum("area")).alias("area"))


@query(f"""WITH {_FEW} SELECT source_id%2+2*source_id source_id, CASE WHEN impact>0 THEN 'good' ELSE 'bad' END type, CAST(impact AS DOUBLE) impact, total_impact_radius, layers_count FROM src""".replace("trunc(min(abs(total_impact_radius)))", "min(abs(total_impact_radius))").replace("trunc(max(abs(total_impact_radius)))", "max(abs(total_impact_radius))"))
def frame_merge(spark, sf):
    """Two frames in one, with ring counts worked out anew."""
    layers, rules = _few(spark, sf)
    even, odd = (FR.build_frame({k: d and d.filter(f"source_id % 2 = {i}") for k, d in layers.items()}, rules, most_layers=4, tile=100.0) for i in (0, 1))
    return FR.merge_frames(even, odd, most_layers=4).sources.select("source_id", "type", "impact", "total_impact_radius", "layers_count")


_CLASSED = """px AS (SELECT tile, "row" r, "col" c, CAST(floor(value/125) AS INT) cls FROM fx_raster)"""


@query(f"""WITH RECURSIVE {_CLASSED}, ed AS (SELECT a.tile, a.r*100+a.c s, b.r*100+b.c t FROM px a JOIN px b ON a.tile=b.tile AND a.cls=b.cls AND abs(a.r-b.r)+abs(a.c-b.c)<=1),
    cl AS (SELECT tile, s, t FROM ed UNION SELECT cl.tile, cl.s, ed.t FROM cl JOIN ed ON ed.tile=cl.tile AND ed.s=cl.t), co AS (SELECT tile, s, min(t) region FROM cl GROUP BY 1, 2)
    SELECT px.tile, cls, count(*)*900.0::DOUBLE area, min(c)*30.0::DOUBLE x0, 960-max(r)*30.0::DOUBLE-30 y0, max(c)*30.0::DOUBLE+30 x1, 960-min(r)*30.0::DOUBLE y1
    FROM px JOIN co ON co.tile=px.tile AND s=r*100+c GROUP BY px.tile, cls, region""")
def pixel_class_regions(spark, sf):
    """Pixels of equal class merged to rectangles, and these dissolved to regions."""
    d = fixture(spark, sf, "fx_raster").withColumns({"cls": F.floor(F.col("value") / 125).cast("int"), "x_min": F.lit(0.0), "y_max": F.lit(960.0), "size_x": F.lit(30.0), "size_y": F.lit(30.0)})
    keys = ["tile", "cls"]
    return G.region_facts(G.dissolved_regions(G.pixel_regions(d, keys), keys, 300.0), keys).drop("region")


_CLIP = "sum((least(b.x1,z.x1)-greatest(b.x0,z.x0))*(least(b.y1,z.y1)-greatest(b.y0,z.y0)))"
_SHARE = "b.x0<z.x1 AND z.x0<b.x1 AND b.y0<z.y1 AND z.y0<b.y1"


def _area(d, *keys):
    return d.groupBy(*keys).agg(r6(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).alias("area"))


def _raster(d):
    return d.withColumns({"row": F.col("r"), "col": F.col("c"), "x_min": F.lit(0.0), "y_max": F.lit(1500.0), "size_x": F.lit(35.0), "size_y": F.lit(25.0)})


@query(f"""WITH {_BINS}, tx AS (SELECT px, c, r, bn.cfvo, clay_pct, silt_pct, sand_pct, clay_pct/(clay_pct+silt_pct+sand_pct)*100.0::DOUBLE cl, silt_pct/(clay_pct+silt_pct+sand_pct)*100.0::DOUBLE si, sand_pct/(clay_pct+silt_pct+sand_pct)*100.0::DOUBLE sa FROM bn JOIN fx_soil USING (px)),
    b AS (SELECT clay_pct, silt_pct, sand_pct, {_TEXTURE} usda_texture, cfvo, c*35.0 x0, c*35.0+35 x1, 1500.0-r*25-25 y0, 1500.0-r*25 y1 FROM tx),
    m AS (SELECT clay_pct, silt_pct, sand_pct, CAST(round_even(avg(cfvo), 0) AS INT) coarse FROM b GROUP BY 1, 2, 3)
    SELECT z.zone_id, b.clay_pct, b.silt_pct, b.sand_pct, usda_texture, coarse, $6({_CLIP}) area FROM b JOIN fx_zones z ON {_SHARE} JOIN m ON m.clay_pct=b.clay_pct AND m.silt_pct=b.silt_pct AND m.sand_pct=b.sand_pct GROUP BY 1, 2, 3, 4, 5, 6""")
def soil_zone_polygons(spark, sf):
    d = P.soil_polygons(_raster(fixture(spark, sf, "fx_soil")), zones_of(spark, sf), cell=TILE)
    return _area(d, "zone_id", *P.SOIL_CLASS, "coarse")


@query(f"""WITH b AS (SELECT tile, $1(round_even(depth/0.2::DOUBLE, 0)*0.2::DOUBLE) depth_m, c*35.0 x0, c*35.0+35 x1, 1500.0-r*25-25 y0, 1500.0-r*25 y1 FROM (SELECT DISTINCT tile, r, c, depth FROM fx_flood WHERE depth>0))
    SELECT zone_id, tile, depth_m, $6({_CLIP}) area FROM (SELECT DISTINCT * FROM b) b JOIN fx_zones z ON {_SHARE} GROUP BY 1, 2, 3""")
def flood_zone_polygons(spark, sf):
    d = P.flood_polygons(_raster(fixture(spark, sf, "fx_flood").withColumnRenamed("depth", "value")), zones_of(spark, sf), 0.2, TILE, ["tile"])
    return _area(d, "zone_id", "tile", "depth_m")


@query(f"""WITH {_GRAD}, s AS (SELECT tile, "row" r, "col" c, round_even(degrees(atan(sqrt(gx*gx+gy*gy)))/15, 0)*15.0::DOUBLE value FROM gd JOIN fx_raster USING (tile, "row", "col")),
    b AS (SELECT tile, value, c*30.0 x0, c*30.0+30 x1, 960.0-r*30-30 y0, 960.0-r*30 y1 FROM s WHERE value>=15)
    SELECT zone_id, tile, value, $6({_CLIP}) area FROM b JOIN fx_zones z ON {_SHARE} GROUP BY 1, 2, 3""")
def terrain_zone_slopes(spark, sf):
    """Classes of slope in each zone, as boxes of pixels."""
    d = fixture(spark, sf, "fx_raster").withColumns({"x_min": F.lit(0.0), "y_max": F.lit(960.0), "size_x": F.lit(30.0), "size_y": F.lit(30.0)})
    return _area(P.terrain_regions(d, "slope", 15.0, (30.0, 30.0), zones_of(spark, sf), TILE), "zone_id", "tile", "value")


# Rivers ---------------------------------------------------------------------------------------------------------

_NETWORK = f"""{_PAIRS}, sg AS (SELECT line_id, pos, part, x, y, x2, y2, d/n length_, n FROM (SELECT *, CAST(greatest(ceil(d/150.0), 1) AS BIGINT) n, unnest(range(CAST(greatest(ceil(d/150.0), 1) AS BIGINT))) part FROM (SELECT *, sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) d FROM pairs))),
    se AS (SELECT line_id, pos, part, x+(x2-x)*part/n x, y+(y2-y)*part/n y, CASE WHEN part+1=n THEN x2 ELSE x+(x2-x)*(part+1)/n END x2, CASE WHEN part+1=n THEN y2 ELSE y+(y2-y)*(part+1)/n END y2, length_ length FROM sg),
    nodes AS (SELECT x, y, row_number() OVER (ORDER BY f)-1 node FROM (SELECT x, y, min(f) f FROM (SELECT x, y, {{'l': line_id, 'p': pos, 'q': part}} f FROM se UNION ALL SELECT x2, y2, {{'l': line_id, 'p': pos, 'q': part+1}} FROM se) GROUP BY x, y)),
    gr AS (SELECT src, dst, e.length length, e.x x, e.y y, e.x2 x2, e.y2 y2 FROM (SELECT u.node src, v.node dst, min({{'length': p.length, 'x': p.x, 'y': p.y, 'x2': p.x2, 'y2': p.y2}}) e FROM se p JOIN nodes u ON u.x=p.x AND u.y=p.y JOIN nodes v ON v.x=p.x2 AND v.y=p.y2 WHERE u.node<>v.node GROUP BY 1, 2)),
    en AS (SELECT src, dst, unnest(['u', 'v']) e, unnest([src, dst]) node, unnest([x, x2]) px, unnest([y, y2]) py, -(y2-y)/sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) ux, (x2-x)/sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) uy FROM gr),
    bo AS (SELECT node, min(water_id) water_id FROM nodes n JOIN fx_water w ON n.x BETWEEN w.x0 AND w.x1 AND n.y BETWEEN w.y0 AND w.y1 GROUP BY node),
    iv AS (SELECT DISTINCT src, dst, e, greatest(CASE WHEN ux=0 THEN CASE WHEN px BETWEEN x0 AND x1 THEN -300.0 ELSE 600.0 END ELSE least((x0-px)/ux, (x1-px)/ux) END, CASE WHEN uy=0 THEN CASE WHEN py BETWEEN y0 AND y1 THEN -300.0 ELSE 600.0 END ELSE least((y0-py)/uy, (y1-py)/uy) END, -300.0) t0,
        least(CASE WHEN ux=0 THEN 300.0 ELSE greatest((x0-px)/ux, (x1-px)/ux) END, CASE WHEN uy=0 THEN 300.0 ELSE greatest((y0-py)/uy, (y1-py)/uy) END, 300.0) t1 FROM en JOIN bo USING (node) JOIN fx_water USING (water_id)),
    ru AS (SELECT *, sum(b) OVER (PARTITION BY src, dst, e ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) run FROM (SELECT *, CASE WHEN t0<=max(t1) OVER (PARTITION BY src, dst, e ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END b FROM iv WHERE t0<=t1)),
    wi AS (SELECT src, dst, e, max(t1)-min(t0) w FROM ru GROUP BY src, dst, e, run HAVING min(t0)<=0 AND max(t1)>=0 AND max(t1)>min(t0)),
    ew AS (SELECT gr.*, coalesce(a.w, 5.0) wu, coalesce(b.w, 5.0) wv FROM gr LEFT JOIN wi a ON a.src=gr.src AND a.dst=gr.dst AND a.e='u' LEFT JOIN wi b ON b.src=gr.src AND b.dst=gr.dst AND b.e='v'),
    nw AS (SELECT node, min(w) width FROM (SELECT src node, wu w FROM ew UNION ALL SELECT dst, wv FROM ew) GROUP BY node)"""


def _network(spark, sf):
    water = fixture(spark, sf, "fx_water").withColumnsRenamed({c: f"b{c}" for c in G.BOX})
    return V.water_graph(fixture(spark, sf, "fx_lines"), water, 150.0, 600.0, cell=100.0)


@query(f"WITH {_NETWORK} SELECT gr.src, gr.dst, $6(length) length, $6((a.width+b.width)/2) width, $6((a.width+b.width)/2*length/50) weight FROM gr JOIN nw a ON a.node=src JOIN nw b ON b.node=dst")
def water_graph_edges(spark, sf):
    """A river network from lines and water: edges with lengths, widths and weights."""
    edges, _ = _network(spark, sf)
    return edges.select("src", "dst", r6("length").alias("length"), r6("width").alias("width"), r6("weight").alias("weight"))


@query(f"WITH {_NETWORK} SELECT node, $6(x) x, $6(y) y, $6(coalesce(width, 5.0)) width FROM nodes LEFT JOIN nw USING (node)")
def water_graph_nodes(spark, sf):
    _, nodes = _network(spark, sf)
    return nodes.select("node", r6("x").alias("x"), r6("y").alias("y"), r6("width").alias("width"))


@query("""WITH RECURSIVE e AS (SELECT src*1000000+dst id, src, dst, cost remain FROM fx_edges),
    n AS (SELECT id, remain, unnest([src, dst]) node FROM e), pr AS (SELECT DISTINCT a.id s, b.id t FROM n a JOIN n b ON a.node=b.node AND a.remain=b.remain),
    cl AS (SELECT s, t FROM pr UNION SELECT cl.s, pr.t FROM cl JOIN pr ON cl.t=pr.s), co AS (SELECT s, min(t) region FROM cl GROUP BY s)
    SELECT remain, edges, count(*) regions FROM (SELECT remain, region, count(*) edges FROM e JOIN co ON id=s GROUP BY 1, 2) GROUP BY 1, 2""")
def edge_regions(spark, sf):
    """Edges of equal value that meet, as regions: how many there are of each size."""
    e = fixture(spark, sf, "fx_edges").select("src", "dst", F.col("cost").alias("remain"))
    return V.dissolved_edges(e).groupBy("remain", "edges").agg(F.count(F.lit(1)).alias("regions"))


@query("""SELECT zone_id, CASE WHEN len(l)=1 THEN l[1] ELSE 'Множество объектов: '||array_to_string([concat('"', x, '"') for x in l], ', ') END "name" FROM (SELECT zone_id, list_sort(list(DISTINCT name)) l FROM fx_boxes WHERE zone_id IS NOT NULL GROUP BY 1)""")
def display_names(spark, sf):
    """Names of single objects and of several."""
    names = fixture(spark, sf, "fx_boxes").filter("zone_id IS NOT NULL").groupBy("zone_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return names.select("zone_id", S.display_name(F.col("names")).alias("name"))


_WORKS = "wp AS (SELECT CASE point_id%4 WHEN 0 THEN 'Завод '||point_id WHEN 1 THEN 'Цех '||point_id WHEN 2 THEN 'Кафе '||point_id END pname, CAST(point_id%4+1 AS INT) lv, x, y FROM fx_points)"


@query(f"""WITH {_WORKS}, wb AS (SELECT source_id, CASE WHEN source_id%3>0 THEN name END bname, x0, y0, x0+30 x1, y0+30 y1 FROM fx_boxes),
    j AS (SELECT source_id, pname, lv FROM wb JOIN wp ON x>=x0-10 AND x<=x1+10 AND y>=y0-10 AND y<=y1+10 WHERE pname LIKE 'Завод%' OR pname LIKE 'Цех%'),
    n AS (SELECT source_id, string_agg(a, ', ' ORDER BY a) "name" FROM (SELECT source_id, pname a FROM j UNION SELECT source_id, bname FROM wb WHERE bname IS NOT NULL) GROUP BY 1)
    SELECT min(source_id) box_id, arg_min(name, source_id) "name", arg_min(coalesce((SELECT max(lv) FROM j WHERE j.source_id=wb.source_id), 4), source_id) "level", x0, y0, x1, y1, 'industrial' type FROM n JOIN wb USING (source_id) GROUP BY x0, y0, x1, y1""")
def industrial_preprocessing(spark, sf):
    """Industrial boxes with the names and danger of what is in them."""
    n = F.col("point_id") % 4
    name = F.when(n == 0, F.concat(F.lit("Завод "), F.col("point_id"))).when(n == 1, F.concat(F.lit("Цех "), F.col("point_id"))).when(n == 2, F.concat(F.lit("Кафе "), F.col("point_id")))
    points = fixture(spark, sf, "fx_points").select(name.alias("name"), (n + 1).cast("int").alias("level"), "x", "y")
    boxes = fixture(spark, sf, "fx_boxes").select(F.col("source_id").alias("box_id"), F.when(F.col("source_id") % 3 > 0, F.col("name")).alias("name"), "x0", "y0", (F.col("x0") + 30).alias("x1"), (F.col("y0") + 30).alias("y1"))
    return FR.industrial_sources(points, boxes, 10.0, TILE)


# Coordinates and functions --------------------------------------------------------------------------------------


@query("SELECT impact, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 FROM fx_boxes WHERE impact=3 GROUP BY 1")
def layer_bounds(spark, sf):
    d = fixture(spark, sf, "fx_boxes").filter("impact = 3")
    return K.total_bounds(d).select(F.lit(3).alias("impact"), *G.BOX)


#: Customers as places in degrees, all over the world.
_PLACES = "pl AS (SELECT point_id, x/1350.0*359.0-179.5 lon, y/1350.0*160.0-80.0 lat FROM fx_points)"


def _places(spark, sf):
    return fixture(spark, sf, "fx_points").select("point_id", (F.col("x") / 1350.0 * 359.0 - 179.5).alias("lon"), (F.col("y") / 1350.0 * 160.0 - 80.0).alias("lat"))


@query(f"WITH {_PLACES}, b AS (SELECT floor(lat/20) band, (min(lon)+max(lon))/2 lon, (min(lat)+max(lat))/2 lat FROM pl GROUP BY 1) SELECT CAST(band AS BIGINT) band, CAST(CASE WHEN lat>=0 THEN 32600 ELSE 32700 END+least(60, floor((lon+180)/6)+1) AS INT) srid FROM b")
def utm_of_bounds(spark, sf):
    d = _places(spark, sf).withColumn("band", F.floor(F.col("lat") / 20))
    b = d.groupBy("band").agg(((F.min("lon") + F.max("lon")) / 2).alias("lon"), ((F.min("lat") + F.max("lat")) / 2).alias("lat"))
    return b.select("band", K.utm_srid(F.col("lon"), F.col("lat")).alias("srid"))


def _utm_sql() -> str:
    e = 2 * _N**0.5 / (1 + _N)
    x = "+".join(["eta", *[f"{a!r}::DOUBLE*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(_ALPHA, 1)]])
    y = "+".join(["xi", *[f"{a!r}::DOUBLE*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(_ALPHA, 1)]])
    return f"""WITH {_PLACES}, z AS (SELECT *, CAST(CASE WHEN lat>=0 THEN 32600 ELSE 32700 END+least(60, floor((lon+180)/6)+1) AS INT) srid FROM pl),
        a AS (SELECT *, radians(lon)-radians((srid%100)*6-183) l, sinh(atanh(sin(radians(lat)))-{e!r}::DOUBLE*atanh({e!r}::DOUBLE*sin(radians(lat)))) t FROM z),
        b AS (SELECT *, atan2(t, cos(l)) xi, atanh(sin(l)/sqrt(1+t*t)) eta FROM a)
        SELECT point_id, srid, round(500000.0+0.9996::DOUBLE*{_R!r}::DOUBLE*({x}), 4) x, round(CASE WHEN srid<32700 THEN 0.0 ELSE 1e7 END+0.9996::DOUBLE*{_R!r}::DOUBLE*({y}), 4) y, $6(lon) lon, $6(lat) lat FROM b"""


@query(_utm_sql())
def reprojected_places(spark, sf):
    """Nodes of a graph in the UTM zone of each, and back."""
    d = _places(spark, sf).withColumn("srid", K.utm_srid(F.col("lon"), F.col("lat")))
    there = K.reprojected(d.select("point_id", "srid", F.col("lon").alias("x"), F.col("lat").alias("y")), 4326, F.col("srid"), [("x", "y")])
    back = K.reprojected(there.withColumns({"lon": F.col("x"), "lat": F.col("y")}), F.col("srid"), 4326, [("lon", "lat")])
    return back.select("point_id", "srid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), r6("lon").alias("lon"), r6("lat").alias("lat"))


@query("""SELECT p_partkey, CASE p_size%6 WHEN 1 THEN -10 WHEN 2 THEN -8 WHEN 3 THEN -6 WHEN 4 THEN -4 ELSE -2 END impact,
    $1((CASE p_size%6 WHEN 1 THEN -10 WHEN 2 THEN -8 WHEN 3 THEN -6 WHEN 4 THEN -4 ELSE -2 END)*CAST(CASE p_size%6 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 WHEN 4 THEN 0.2 ELSE 0.1 END AS DOUBLE)*1.5::DOUBLE*1000.0::DOUBLE) radius,
    CASE WHEN p_partkey%5=0 THEN 4.0::DOUBLE ELSE $1(exp(-(p_partkey%5-0.5::DOUBLE)*(0.7::DOUBLE*pow(exp(1.0::DOUBLE),2.0::DOUBLE))/5.0::DOUBLE)*4.0::DOUBLE) END ring, round_even(p_retailprice/25.0::DOUBLE, 0)*25.0::DOUBLE price FROM part""")
def sql_functions(spark, sf):
    """The rules as functions of SQL text."""
    register(spark)
    text = "SELECT p_partkey, vg_danger_impact(CAST(p_size % 6 AS INT)) impact, vg_impact_radius(vg_danger_impact(CAST(p_size % 6 AS INT)), vg_danger_fading(CAST(p_size % 6 AS INT)), 1.5D) radius, vg_ring_impact(4D, 5D, p_partkey % 5) ring, vg_quantised(p_retailprice, 25D) price FROM {part}"
    return spark.sql(text, part=spark.read.parquet(f"{sf}/part.parquet"))


@query("SELECT DISTINCT user_id id FROM events WHERE user_id IS NOT NULL ORDER BY id")
def sorted_ids(spark, sf):
    return tile_ids(spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("user_id", "id"))


@query("SELECT zone_id, list_sort(list(DISTINCT source_id)) source_id, list_sort(list(DISTINCT name)) name, list_sort(list(DISTINCT impact)) impact, list_sort(list(DISTINCT x0)) x0 FROM fx_boxes GROUP BY zone_id")
def collapsed_columns(spark, sf):
    return C.collapsed(fixture(spark, sf, "fx_boxes").select("zone_id", "source_id", "name", "impact", "x0"), ["zone_id"])


@query("SELECT zone_id, list(name ORDER BY source_id) name, list(CASE WHEN impact>0 THEN impact END ORDER BY source_id) impact, list(source_id ORDER BY source_id) source_id FROM fx_boxes GROUP BY zone_id")
def collected_columns(spark, sf):
    d = fixture(spark, sf, "fx_boxes").select("zone_id", "source_id", "name", F.when(F.col("impact") > 0, F.col("impact")).alias("impact"))
    return C.collected(d, ["zone_id"], ["source_id"])


@query("""SELECT p_partkey, name FROM (SELECT p_partkey, CASE p_partkey%9 WHEN 0 THEN 'Завод '||p_name WHEN 1 THEN p_name||' котельная' WHEN 2 THEN 'Карьерный '||p_name WHEN 3 THEN 'Магазин '||p_name WHEN 4 THEN NULL WHEN 5 THEN 'промышленная '||p_name WHEN 6 THEN p_name||' (ТБО)' ELSE p_name END "name" FROM part)
    WHERE regexp_matches(upper(name), 'ПОЛИГОН|ЗАВОД|ТБО|ТКО|ЦЕХ|КОТЕЛЬНАЯ|РУДНИК|КАНАЛ|КАРЬЕР|СТАНЦИЯ|ПРОИЗВОД|ПРОМЫШЛЕН')""")
def dangerous_names(spark, sf):
    """Names of dangerous objects by their stems, in any case."""
    part, n = spark.read.parquet(f"{sf}/part.parquet"), F.col("p_name")
    names = [F.concat(F.lit("Завод "), n), F.concat(n, F.lit(" котельная")), F.concat(F.lit("Карьерный "), n), F.concat(F.lit("Магазин "), n), F.lit(None).cast("string"), F.concat(F.lit("промышленная "), n), F.concat(n, F.lit(" (ТБО)")), n, n]
    d = part.select("p_partkey", F.get(F.array(*names), (F.col("p_partkey") % 9).cast("int")).alias("name"))
    return d.filter(S.is_dangerous_name(F.col("name")))


# Files ----------------------------------------------------------------------------------------------------------


@query("SELECT source_id, name, x0, y0, x1, y1 FROM fx_boxes WHERE x0<=600 AND x1>=300 AND y0<=500 AND y1>=250")
def geoparquet_window(spark, sf):
    """Boxes written as GeoParquet and read again within bounds, which reach the scan."""
    path = f"{shared_dir(spark).rstrip('/')}/geoparquet-{uuid.uuid4().hex}"
    boxes = fixture(spark, sf, "fx_boxes").select("source_id", "name", shapes.box(*map(F.col, G.BOX)).alias("geometry"), *G.BOX)
    geoparquet.write_geoparquet(boxes, path, srid=32636)
    return geoparquet.read_geoparquet(spark, path, (300.0, 250.0, 600.0, 500.0)).drop("geometry")


# Texts ----------------------------------------------------------------------------------------------------------

_INFLUENCE = f"""WITH {_RS}, {_RB}, {_LB}, pt AS (SELECT point_id, x-5 x0, y-5 y0, x+5 x1, y+5 y1 FROM fx_points),
    hit AS (SELECT z.point_id, source_id, 'source' kind FROM rs b JOIN pt z ON {_HIT} UNION ALL SELECT z.point_id, b.source_id, 'effect' FROM rb b JOIN pt z ON {_HIT} JOIN rs s ON s.source_id=b.source_id WHERE NOT (z.x0>=s.x0 AND z.y0>=s.y0 AND z.x1<=s.x1 AND z.y1<=s.y1)),
    fo AS (SELECT DISTINCT point_id, kind, impact>0 good, name, label, CAST(reach AS DOUBLE) radius FROM hit JOIN rs USING (source_id) LEFT JOIN lb USING (type)),
    se AS (SELECT point_id, kind, good, string_agg(chr(10)||'• Название: '||name||chr(10)||'• Тип: '||coalesce(label, 'Неизвестно')||chr(10)||'• Радиус воздействия: '||radius||chr(10)||repeat('-', 40), chr(10) ORDER BY name, label NULLS FIRST, radius) t FROM fo GROUP BY 1, 2, 3),
    te AS (SELECT point_id, string_agg(chr(10)||'=== '||CASE WHEN kind='source' AND good THEN 'Источники положительного воздействия' WHEN kind='source' THEN 'Источники негативного воздействия' WHEN good THEN 'Влияние от положительных источников' ELSE 'Влияние от негативных источников' END||' ==='||chr(10)||t, chr(10)||chr(10) ORDER BY kind DESC, good DESC) report FROM se GROUP BY 1)
    SELECT point_id, coalesce(report, 'Нет данных о влияющих объектах') report FROM fx_points LEFT JOIN te USING (point_id)"""


@query(_INFLUENCE)
def influencer_texts(spark, sf):
    s, b, labels = _report_sources(spark, sf)
    return T.point_texts(s, b, fixture(spark, sf, "fx_points"), labels, TILE)


_MEANING = " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in T.MEANINGS.items())


@query(f"""WITH m AS (SELECT zone_id, [5.0, 4.0, 3.0, 2.5, 2.0, 1.0, 0.0][zone_id%7+1]::DOUBLE score, zone_id%9-4.5::DOUBLE mean_impact, zone_id%4*100.5::DOUBLE area, CASE WHEN zone_id%3>0 THEN 'r'||zone_id ELSE '' END report FROM fx_zones)
    SELECT zone_id, 'Полная оценка территории:'||chr(10)||'  Абсолютная оценка: '||regexp_replace(CAST(score AS VARCHAR), '[.]0$', '')||chr(10)||'  Описание объектов: '||CASE score {_MEANING} END||chr(10)||chr(10)||'  Относительная оценка: '||mean_impact||chr(10)
    ||'  Интерпретация оценки: '||report||chr(10)||chr(10)||'  Площадь: '||CASE WHEN area>0 THEN CAST(area AS VARCHAR) ELSE 'Неизвестно' END||chr(10) AS "text" FROM m""")
def mark_texts(spark, sf):
    """Marks of zones in words."""
    z = fixture(spark, sf, "fx_zones").select("zone_id")
    score = F.get(F.array(*[F.lit(x) for x in (5.0, 4.0, 3.0, 2.5, 2.0, 1.0, 0.0)]), (F.col("zone_id") % 7).cast("int"))
    marks = z.select("zone_id", score.alias("score"), (F.col("zone_id") % 9 - 4.5).alias("mean_impact"), (F.col("zone_id") % 4 * 100.5).alias("area"))
    reports = z.filter("zone_id % 3 > 0").select("zone_id", F.concat(F.lit("r"), F.col("zone_id").cast("string")).alias("report"))
    return T.mark_texts(marks, reports)


@query()
def shortened_names(spark, sf):
    """Long names cut at words; tests hold it against the standard library of Python."""
    d = spark.read.parquet(f"{sf}/part.parquet")
    long = F.concat_ws(" ", "p_name", F.repeat(F.concat("p_name", F.lit("-and-more  ")), (F.col("p_partkey") % 9).cast("int")))
    return d.select("p_partkey", T.shortened(long).alias("name"))

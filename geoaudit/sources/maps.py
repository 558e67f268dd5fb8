"""Maps as HTML files that draw with Leaflet; all that they show is bounded before it is collected."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layers
from .points import Profile, profile

# Colours, sizes and titles of the layers.
STYLE = {
    "points": {"radius": 2, "opacity": 0.45},
    "grid": {"color": "#3182bd", "title": "significant grid region"},
    "boxes": {"color": "#756bb1", "title": "non-overlapping KMeans scan region"},
    "clusters": {"color": "#f16913", "fill": 0.12},
    "tiles": "https://{s}.basemaps.cartocdn.com/light_all/{z}/{x}/{y}{r}.png",
    "zoom": 5,
}

_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>%(title)s</title>
<link rel="stylesheet" href="https://unpkg.com/leaflet@1.9.4/dist/leaflet.css">
<script src="https://unpkg.com/leaflet@1.9.4/dist/leaflet.js"></script>
<style>html,body,#map{height:100%%;margin:0}</style></head>
<body><div id="map"></div><script>
const data = %(data)s;
const map = L.map("map").setView(data.center, data.zoom);
L.tileLayer(data.tiles).addTo(map);
const sample = L.layerGroup(data.points.map(p => L.circleMarker([p[0], p[1]], {radius: data.radius, color: p[2], opacity: data.opacity, fillOpacity: data.opacity}))).addTo(map);
for (const b of data.boxes) L.rectangle([[b.lat_min, b.lon_min], [b.lat_max, b.lon_max]], {color: b.color, weight: 3, fill: false}).bindTooltip(b.title).addTo(map);
for (const h of data.hulls) L.polygon(h.at, {color: h.color, fillOpacity: h.fill}).bindTooltip(h.title).addTo(map);
if (data.extent) map.fitBounds(data.extent);
L.control.layers(null, {"Sampled outcomes": sample}).addTo(map);
</script></body></html>
"""


def cluster_shapes(points: DataFrame, members: DataFrame) -> list[dict]:
    """Hull and counts of each cluster; a box where the hull has fewer than three corners."""
    joined = points.join(members, "point_id")
    stats = joined.groupBy("cluster_label").agg(F.count("*").alias("n"), F.sum("outcome").alias("p"))
    title = F.format_string("HDBSCAN cluster=%d, n=%d, p=%d, rho=%.3f", F.col("cluster_label"), F.col("n"), F.col("p"), F.col("p") / F.col("n"))
    rows = layers.hulls(joined, "cluster_label").join(layers.bounds(joined, "cluster_label"), "cluster_label").join(stats, "cluster_label")
    return [r.asDict(recursive=True) for r in rows.withColumn("title", title).orderBy("cluster_label").collect()]


def map_data(points: DataFrame, p: Profile, grid: list[dict] = (), boxes: list[dict] = (), clusters: list[dict] = (), most: int = 5000, seed: int = 42) -> dict:
    sample = layers.stratified_sample(points, most, seed).select("lat", "lon", "color").collect()
    shown = [{k: b[k] for k in ("lon_min", "lat_min", "lon_max", "lat_max")} | STYLE["boxes"] for b in boxes]
    shown += [{"lon_min": g["lon_start"], "lat_min": g["lat_start"], "lon_max": g["lon_end"], "lat_max": g["lat_end"]} | STYLE["grid"] for g in grid]
    hulls = []
    for c in clusters:
        if len(c["hull"]) >= 3:
            hulls.append({"at": [[v["lat"], v["lon"]] for v in c["hull"]], "title": c["title"]} | STYLE["clusters"])
        else:
            shown.append({k: c[k] for k in ("lon_min", "lat_min", "lon_max", "lat_max")} | {"color": STYLE["clusters"]["color"], "title": c["title"]})
    return {
        "center": [p.lat_mean or 0.0, p.lon_mean or 0.0], "zoom": STYLE["zoom"], "tiles": STYLE["tiles"], **STYLE["points"],
        "points": [[r["lat"], r["lon"], r["color"]] for r in sample], "boxes": shown, "hulls": hulls,
        "extent": [[p.lat_min, p.lon_min], [p.lat_max, p.lon_max]] if p.n else None,
    }


def map_rows(data: dict) -> list[tuple]:
    """What a map shows, as ``layer, lon_min, lat_min, lon_max, lat_max, color, title``: its middle and extent, points, boxes, and hulls by their bounds."""
    lat, lon = data["center"]
    rows = [("center", lon, lat, lon, lat, None, f"zoom {data['zoom']}")]
    if data["extent"]:
        (lat_min, lon_min), (lat_max, lon_max) = data["extent"]
        rows.append(("extent", lon_min, lat_min, lon_max, lat_max, None, None))
    rows += [("point", x, y, x, y, color, None) for y, x, color in data["points"]]
    rows += [("box", b["lon_min"], b["lat_min"], b["lon_max"], b["lat_max"], b["color"], b["title"]) for b in data["boxes"]]
    for h in data["hulls"]:
        lats, lons = zip(*h["at"], strict=True)
        rows.append(("hull", min(lons), min(lats), max(lons), max(lats), h["color"], h["title"]))
    return rows


def save_map(points: DataFrame, path: str | Path, p: Profile | None = None, title: str = "map", **layers_and_limits) -> Path:
    """Write a map; see ``map_data`` for what it can show."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    data = json.dumps(map_data(points, p or profile(points), **layers_and_limits)).replace("</", "<\\/")
    path.write_text(_PAGE % {"title": html.escape(title), "data": data}, encoding="utf-8")
    return path

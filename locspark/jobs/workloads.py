"""Whole workloads, as tables by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locspark.operators import assign, filters, floods, images, localize, render, spatial, stats
from locspark.operators.graph import written
from locspark.operators.ordered import in_order, with_numbers


def numbered(found: DataFrame) -> DataFrame:
    """Localizations with an id within their movie, in order of frame, peak and place. Runs jobs when called."""
    rest = [c for c in ("peak", "group_id") if c in found.columns]
    return with_numbers(in_order(found, "movie_id", ["frame", *rest, "y", "x"]), "movie_id", "loc_id").drop("part", "place")


def cluster_speckles(locs: DataFrame, eps: float | DataFrame | None = None, min_samples: int = 3, levels: int = 2) -> dict[str, DataFrame]:
    """Density clusters (eps of each movie by the knee), checked in time, parted: locs with cluster_id and sub_cluster_id, and the clusters' properties and stats."""
    eps = written(spatial.knee_eps(locs, min_samples=min_samples)) if eps is None else eps
    found = written(floods.subcluster(written(stats.validate_temporal(spatial.dbscan(locs, eps, min_samples))), levels))
    return {"locs": found, "properties": stats.cluster_properties(found), "stats": stats.cluster_stats(found)}


def localize_filter_cluster(frames: DataFrame, eps: float | DataFrame | None = None, min_samples: int = 3) -> dict[str, DataFrame]:
    """From frames to clusters: fitted emitters, the filter cascade, density clusters. locs, funnel, and all of cluster_speckles."""
    found = written(numbered(localize.localize_grouped(frames)))
    kept, funnel = filters.cascade_and_funnel(found)
    kept = written(kept)
    out = cluster_speckles(kept, eps, min_samples)
    return out | {"found": found, "funnel": funnel, "clusters": stats.cluster_table(out["locs"].filter("cluster_id <> -1"))}


def _labelled(marker: DataFrame, height: int, width: int, segment: Callable[..., DataFrame], **sizes: int) -> DataFrame:
    """Labels of the resized marker: of an image for each movie, if it has a movie_id."""
    key = "movie_id" if "movie_id" in marker.columns else "image_id"
    found = segment(images.resize_image(marker.withColumnRenamed(key, "image_id"), height, width), **sizes)
    return written(found.withColumnRenamed("image_id", key))


def analyze_movie(frames: DataFrame, marker: DataFrame, height: int, width: int, **sizes: int) -> dict[str, DataFrame]:
    """From frames and marker pixels: locs, labels, enrichment by density, speckles and the rendered image.

    marker: of one image (image_id) for all movies, or of one for each movie (movie_id). sizes: small, closing, least, most
    of segment_speckles.
    """
    locs = written(numbered(localize.localize_centroid(frames)))
    labels = _labelled(marker, height, width, images.segment_speckles, **sizes)
    placed = written(assign.assign_to_speckles(locs, labels, height, width))
    return {
        "locs": placed, "labels": labels, "enrichment": assign.enrichment_density(placed, labels, height, width), "points": assign.located_points(placed),
        "render": render.render_gaussian_pdf(placed, height, width), "speckles": assign.speckle_stats(placed, labels),
    }


def analyze_movie_counts(frames: DataFrame, marker: DataFrame, height: int, width: int, **sizes: int) -> dict[str, DataFrame]:
    """The other way: localizations over the background, speckles flooded from their distance to it, pixels by rounding, enrichment by counts, three renders.

    marker: as in analyze_movie. sizes: small of segment_by_distance. `tables.write_localizations(locs, path, csv=True)` writes the rows.
    """
    locs = written(numbered(localize.localize_bgsub(frames)))
    labels = _labelled(marker, height, width, floods.segment_by_distance, **sizes)
    placed = written(assign.assign_to_speckles(locs, labels, height, width, "round"))
    return {
        "locs": placed, "labels": labels, "enrichment": assign.enrichment_counts(placed), "speckles": assign.speckle_stats(placed, labels, molecules=True),
        **{f"render_{mode}": render.render_gaussian_peak(placed, height, width, mode=mode) for mode in ("precision", "photon", "fixed")},
    }


def analyze_marker_dapi(marker: DataFrame, dapi: DataFrame, least_nucleus: int = 5000, least_speckle: int = 100, radius: int = 30) -> dict[str, DataFrame]:
    """From marker and DAPI pixels of the same images: nuclei, speckles within them, their region table and the report."""
    nuclei = written(images.segment_nuclei(dapi, least_nucleus))
    speckles = written(floods.segment_by_h_maxima(marker, radius, least_speckle, nuclei))
    regions = written(images.region_props(speckles, marker))
    nucleus_regions = images.region_props(nuclei, dapi)
    return {"nuclei": nuclei, "speckles": speckles, "regions": regions, "report": images.region_report(nucleus_regions, regions)}

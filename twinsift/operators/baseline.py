"""The baseline: content fingerprints of known clusters, so that only new ones count against a gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.scalar import member_hash


def cluster_fingerprints(clusters: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """``(cluster, fingerprint)`` from the detector, the kind and the sorted hashes of the members' lines.

    ``clusters(cluster, detector, kind)``, ``members(cluster, path, start_line, end_line)``, ``files(path, text)``. Line
    numbers and line ends do not matter; a member whose file is missing is known by its place.
    """
    texts = files.groupBy("path").agg(F.max("text").alias("text"))
    hashed = members.join(texts, "path", "left").select("cluster", member_hash(F.col("path"), F.col("text"), F.col("start_line"), F.col("end_line")).alias("h"))
    joined = hashed.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("h")), "|").alias("hs"))
    whole = F.sha2(F.concat_ws("|", "detector", "kind", "hs"), 256)
    return clusters.join(joined, "cluster").select("cluster", whole.alias("fingerprint"))


def split_against(fingerprints: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(new, known)`` clusters by whether the baseline holds their fingerprint."""
    return fingerprints.join(baseline.select("fingerprint"), "fingerprint", "left_anti"), fingerprints.join(baseline.select("fingerprint"), "fingerprint", "left_semi")

"""Grouping copies: exact groups first, an inverted-index join of representatives, and connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions.scalar import jaccard, size_ratio
from twinsift.session import Scratch


def postings(items: DataFrame, item: str = "id", features: str = "features", max_posting: int | None = None) -> DataFrame:
    """``(item, feature)``: the distinct features each item keeps; features of more than ``max_posting`` items are dropped."""
    rows = items.select(F.col(item), F.explode(F.array_distinct(features)).alias("feature")).where(F.col("feature").isNotNull())
    if max_posting is None:
        return rows
    held = rows.groupBy("feature").agg(F.count("*").alias("held")).where(F.col("held") <= max_posting).select("feature")
    return rows.join(held, "feature").select(item, "feature")


def candidate_pairs(items: DataFrame, min_jaccard: float, max_posting: int | None = None, item: str = "id", features: str = "features") -> DataFrame:
    """``(a, b, overlap, jaccard)``, ``a < b``: items whose kept features overlap by at least ``min_jaccard``.

    Sizes count kept features only. With a posting cut each feature meets at most ``max_posting`` items, so the join is
    linear. Without one, a prefix filter bounds it exactly: features are ordered by how many items hold them, and a pair
    that reaches the threshold shares one of the first ``size - ceil(t * size) + 1`` of each side.
    """
    kept = postings(items, item, features, max_posting)
    if max_posting is not None:
        sizes = kept.groupBy(item).agg(F.count("*").alias("size"))
        both = kept.join(sizes, item)
        left = both.select(F.col(item).alias("a"), F.col("size").alias("na"), "feature")
        right = both.select(F.col(item).alias("b"), F.col("size").alias("nb"), "feature")
        met = left.join(right, "feature").where(F.col("a") < F.col("b")).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("overlap"))
        return met.withColumn("jaccard", jaccard(F.col("overlap"), F.col("na"), F.col("nb"))).where(F.col("jaccard") >= min_jaccard).select("a", "b", "overlap", "jaccard")
    held = kept.groupBy("feature").agg(F.count("*").alias("held"))
    sets = kept.join(held, "feature").groupBy(item).agg(F.array_sort(F.collect_list(F.struct("held", "feature"))).alias("ranked"))
    sets = Scratch(items.sparkSession, "pairs").cut(sets.select(F.col(item).alias("id"), F.transform("ranked", lambda x: x["feature"]).alias("tokens")), "sets")
    size = F.size("tokens")
    reach = size - F.ceil(size * F.lit(min_jaccard) - 1e-9).cast("int") + 1
    keys = sets.select("id", size.alias("n"), F.explode(F.slice("tokens", F.lit(1), reach)).alias("feature"))
    left, right = keys.select(F.col("id").alias("a"), F.col("n").alias("na"), "feature"), keys.select(F.col("id").alias("b"), F.col("n").alias("nb"), "feature")
    close = F.least("na", "nb") >= F.greatest("na", "nb") * min_jaccard - 1e-9
    met = left.join(right, "feature").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    counted = met.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    counted = counted.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).cast("bigint").alias("overlap"))
    return counted.withColumn("jaccard", jaccard(F.col("overlap"), F.col("na"), F.col("nb"))).where(F.col("jaccard") >= min_jaccard).select("a", "b", "overlap", "jaccard")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)``: every end of an edge and the smallest id it is linked with, directly or through others.

    Alternates large and small stars until the edges stand still; each round is a table in the shared folder. Nulls and
    loops link nothing.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    ends = scratch.cut(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ends")
    stars = scratch.cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before = None
    while not stars.isEmpty():
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = scratch.cut(small, "stars")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(stars)
        stars = after
        if mark == before:
            break
        before = mark
    roots = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


Confirm = Callable[[DataFrame], DataFrame]


def cluster_units(
    units: DataFrame,
    threshold: float,
    candidate_jaccard: float,
    max_posting: int | None = None,
    confirm: Confirm | None = None,
    sized: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Clusters of ``units(ord, normalized, raw, features[, size, ...])`` as ``clusters`` and ``members``.

    Units with one normalised key are a group, represented by its first unit in order. Only representatives are
    compared; without ``confirm`` the candidates' Jaccard is the similarity (set semantics), with it the pairs get the
    payload of both sides and come back as ``(a, b, similarity)``. Groups linked by confirmed pairs are one cluster.

    ``clusters(cluster, kind, similarity, members)``: kind is near-miss for several groups, else identical where all raw
    keys agree, else normalized; similarity is the weakest confirmed link, 1 within one group. Clusters of one unit do
    not exist. ``members(cluster, ord)``.
    """
    scratch = Scratch(units.sparkSession, "clusters")
    grouped = scratch.cut(units.select("ord", F.sha2(F.coalesce("normalized", F.lit("")), 256).alias("key"), F.sha2(F.coalesce("raw", F.lit("")), 256).alias("raw")), "keys")
    first = grouped.groupBy("key").agg(F.min("ord").alias("head"))
    placed = scratch.cut(grouped.join(first, "key").select("ord", "head", "raw"), "groups")
    heads = units.join(placed.where("ord = head").select("ord"), "ord", "left_semi")
    pairs = candidate_pairs(heads.select(F.col("ord").alias("id"), "features"), candidate_jaccard, max_posting)
    if confirm is None:
        links = pairs.where(F.col("jaccard") >= threshold).select("a", "b", F.col("jaccard").alias("similarity"))
    else:
        side = [c for c in heads.columns if c not in ("normalized", "raw", "features")]
        for end in ("a", "b"):
            pairs = pairs.join(heads.select(*[F.col(c).alias(end if c == "ord" else f"{c}_{end}") for c in side]), end)
        if sized:
            pairs = pairs.where(size_ratio(F.col("size_a"), F.col("size_b")) >= threshold)
        links = confirm(pairs).where(F.col("similarity") >= threshold)
    links = scratch.cut(links.select("a", "b", "similarity"), "links")
    joined = components(links)
    weakest = links.join(joined.select(F.col("id").alias("a"), "component"), "a").groupBy("component").agg(F.min("similarity").alias("weakest"))
    members = placed.join(joined.select(F.col("id").alias("head"), "component"), "head", "left").select("ord", "head", "raw", F.coalesce("component", "head").alias("cluster"))
    members = scratch.cut(members, "members")
    groups = members.groupBy("cluster").agg(F.count("*").alias("members"), F.count_distinct("head").alias("heads"), F.min("raw").alias("low"), F.max("raw").alias("high")).where("members >= 2")
    kind: Column = F.when(F.col("heads") > 1, "near-miss").when(F.col("low") == F.col("high"), "identical").otherwise("normalized")
    clusters = groups.join(weakest, groups.cluster == weakest.component, "left").select("cluster", kind.alias("kind"), F.when(F.col("heads") > 1, F.col("weakest")).otherwise(1.0).alias("similarity"), "members")
    clusters = scratch.cut(clusters, "clusters")
    return clusters, members.join(clusters.select("cluster"), "cluster", "left_semi").select("cluster", "ord")


def exact_groups(units: DataFrame, key: str, order: str) -> DataFrame:
    """Each unit with its group's first unit: ``(order, head)``; units without a key stand alone."""
    w = Window.partitionBy(key)
    return units.where(F.col(key).isNotNull()).select(F.col(order), F.min(order).over(w).alias("head"))

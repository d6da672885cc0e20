"""Problem 3: consolidating pairwise matches into groups by low-diameter decomposition.

Every round draws an exponential shift for each vertex; a vertex whose shift is large starts to grow a cluster early,
and a vertex joins the cluster that reaches it first (arrival = start + hops) within ``RADIUS`` hops. Clusters become
super-vertices, edges inside a cluster vanish, and the next round works on the edges between clusters. The per-round
assignments are composed at the end. A smaller ``BETA`` spreads the shifts and leaves fewer edges between clusters: an
edge on its own survives a round with probability ``1 - exp(-BETA)``. A round has a fixed number of steps, so a chain of
any depth takes a number of rounds that is logarithmic in its length, and a hub is absorbed in one round.

Nothing is collected: a round is one table of assignments and one table of remaining edges, both written to the shared
folder. Messages to a vertex are reduced by ``min`` before the shuffle, so a hub that touches a third of all edges
sends one row per task; the joins that read a hub's edges are split by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.session import Scratch

#: Rate of the exponential shifts, and the hops that a cluster grows in a round.
BETA = 0.05
RADIUS = 3
SEED = 20_240_601


def valid_links(edges: DataFrame, low: float = 0.85, high: float = 1.0) -> DataFrame:
    """Distinct undirected links ``x < y`` of an ``edges(a, b, similarity)`` table.

    Rows with a null end, equal ends, or a similarity that is null, NaN or outside ``low..high`` link nothing.
    Repeated pairs count once, whichever way round they are written. Other columns are ignored.
    """
    similarity = F.col("similarity")
    return (
        edges.select("a", "b", "similarity")
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .where(similarity.isNotNull() & ~F.isnan(similarity) & similarity.between(low, high))
        .select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        .distinct()
    )


def _start(vertex: Column, turn: Column, beta: float) -> Column:
    """Time at which a vertex begins its own cluster: its exponential draw before time 0.

    The draw is fresh in every round. Its number is a column, so that all rounds run the same generated code.
    """
    mantissa = F.pmod(F.xxhash64(F.lit(SEED), turn, vertex), F.lit(1 << 52)).cast("double")
    uniform = (mantissa + 1.0) / float(1 << 52)
    return F.log(uniform) / beta


def _grow(links: DataFrame, beta: float, radius: int) -> DataFrame:
    """One decomposition of the graph ``links(x, y, turn)``: ``(v, c)``, the centre whose cluster reaches each vertex first."""
    ends = F.array(
        F.struct(F.col("x").alias("src"), F.col("y").alias("dst"), "turn"),
        F.struct(F.col("y").alias("src"), F.col("x").alias("dst"), "turn"),
    )
    both = links.select(F.explode(ends).alias("e")).select("e.src", "e.dst", "e.turn")
    stay = both.select("src", "turn").distinct().select("src", F.col("src").alias("dst"), "turn")
    arcs = both.unionByName(stay)
    hop = F.when(F.col("src") == F.col("dst"), 0.0).otherwise(1.0)
    first = arcs.select(
        F.col("dst").alias("v"),
        F.struct((_start(F.col("src"), F.col("turn"), beta) + hop).alias("at"), F.col("src").alias("c")).alias("m"),
    )
    state = first.groupBy("v").agg(F.min("m").alias("m"))
    for _ in range(radius - 1):
        told = arcs.join(state, arcs.src == state.v).select(
            F.col("dst").alias("v"), F.struct((F.col("m.at") + hop).alias("at"), F.col("m.c").alias("c")).alias("m")
        )
        state = told.groupBy("v").agg(F.min("m").alias("m"))
    return state.select("v", F.col("m.c").alias("c"))


def decompose(links: DataFrame, beta: float = BETA, radius: int = RADIUS) -> DataFrame:
    """``(v, root)`` for every vertex of ``links(x, y)``: equal roots exactly for connected vertices.

    An empty graph gives an empty result. ``links`` must hold no nulls and no loops (see ``valid_links``).
    """
    scratch = Scratch(links.sparkSession, "ldd")
    rest = scratch.cut(links.select("x", "y", F.lit(0).alias("turn")), "links")
    maps: list[DataFrame] = []
    while not rest.isEmpty():
        grown = scratch.cut(_grow(rest, beta, radius), "assignment")
        maps.append(grown)
        to_x = grown.select(F.col("v").alias("x"), F.col("c").alias("cx"))
        to_y = grown.select(F.col("v").alias("y"), F.col("c").alias("cy"))
        between = (
            rest.join(to_x, "x")
            .join(to_y, "y")
            .where(F.col("cx") != F.col("cy"))
            .select(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y"), (F.col("turn") + 1).alias("turn"))
            .distinct()
        )
        contracted = scratch.cut(between, "links")
        scratch.drop(rest)
        rest = contracted
    if not maps:
        return rest.select(F.col("x").alias("v"), F.col("y").alias("root"))
    whole = maps[-1].select("v", F.col("c").alias("root"))
    for below in reversed(maps[:-1]):
        above = whole.select(F.col("v").alias("c"), "root")
        whole = below.join(above, "c", "left").select("v", F.coalesce("root", "c").alias("root"))
    return whole


def unit_groups(edges: DataFrame, low: float = 0.85, high: float = 1.0) -> DataFrame:
    """``(group_id, unit_id)`` for every unit linked with another one; ``group_id`` is the group's smallest unit.

    Defined cases: an empty table, or one without a valid link, gives no rows; units without a valid link are left
    out; repeated and reversed edges, nulls, NaN and loops are handled as in ``valid_links``; extra columns of any
    name are ignored.
    """
    members = Scratch(edges.sparkSession, "groups").cut(decompose(valid_links(edges, low, high)), "members")
    names = members.groupBy("root").agg(F.min("v").alias("group_id"))
    return members.join(names, "root").select("group_id", F.col("v").alias("unit_id"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """``(group_id, members)``: how many units each group has."""
    return groups.groupBy("group_id").agg(F.count("*").alias("members"))

"""Problem 1: all similar pairs between set-valued records, by a size-aware overlap join.

A Jaccard threshold asks two sets of sizes ``s`` and ``p`` for an overlap of at least ``need(s, p)``. A pair of small
sets is found by an equi-join on token subsets of exactly that size: whoever shares such a subset is a result, so no
false candidate arises. A pair with a large set is found by scanning inverted lists over the rarest tokens of each set
(of which a result must share one), and then its overlap is counted. A set is small while it has at most
``SUBSET_BUDGET`` subsets to enumerate; larger sizes would have too many.

Equal sets are collapsed first: the join runs over distinct sets, and their holders are put back at the end. Long
inverted lists are not scanned by single tokens: where all tokens two sets share are frequent, they must share several
tokens of a slightly longer prefix, and the join key is that combination. How many depends on the larger set's size, so
that a set of thousands of tokens has no more combinations than a short one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import ceil, comb, floor

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.session import Scratch

THRESHOLD = 0.85
MIN_SIZE = 3
SUBSET_BUDGET = 48
#: No set is small beyond this size, however few subsets a threshold near 1 asks for.
LARGEST_SMALL = 256
#: An inverted list longer than this is scanned by combinations of up to HOT_RUN tokens, whatever the size of the table;
#: of the lengths that leave a set at most HOT_KEYS combinations the longest is taken.
HOT_LEAST, HOT_RUN, HOT_KEYS = 200, 3, 600


class SizeRule:
    """The exact integer arithmetic of one threshold."""

    def __init__(self, threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.t = Fraction(str(threshold))

    def need(self, s: int, p: int) -> int:
        """Least overlap at which sets of these sizes reach the threshold."""
        return ceil(self.t * (s + p) / (1 + self.t))

    def partners(self, s: int) -> range:
        return range(ceil(self.t * s), floor(s / self.t) + 1)

    def subsets(self, s: int) -> int:
        return sum(comb(s, self.need(s, p)) for p in self.partners(s) if self.need(s, p) <= min(s, p))

    def largest_small(self, budget: int) -> int:
        s = 1
        while s < LARGEST_SMALL and self.subsets(s + 1) <= budget:
            s += 1
        return s


def distinct_values(features: str = "features") -> Column:
    """The sorted distinct non-null values of an array column; a null array stays null."""
    return F.array_sort(F.array_distinct(F.filter(F.col(features).cast("array<bigint>"), lambda x: x.isNotNull())))


def record_sets(records: DataFrame, key: str, features: str = "features", least: int = MIN_SIZE) -> DataFrame:
    """``(id, tokens)``: one row for each record id, its distinct values sorted; ids with fewer than ``least`` left out.

    An id delivered more than once counts once; should its deliveries differ, the smallest set in array order holds.
    """
    return (
        records.select(F.col(key).cast("bigint").alias("id"), distinct_values(features).alias("tokens"))
        .where(F.col("id").isNotNull() & (F.size("tokens") >= least))
        .groupBy("id")
        .agg(F.min("tokens").alias("tokens"))
    )


def set_key(tokens: str = "tokens") -> Column:
    """128 bits that stand for a set's content."""
    return F.unhex(F.md5(F.array_join(F.transform(F.col(tokens), lambda x: x.cast("string")), ",").cast("binary")))


def _subset_keys(rule: SizeRule, small: int):
    """Emit, for each small set and each small partner size, its token subsets of the needed size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sid, low, high, key = [], [], [], []
            for ident, tokens in zip(batch["sid"], batch["tokens"]):
                tokens = np.asarray(tokens, np.int64)
                s = len(tokens)
                hashed: dict[int, list[int]] = {}
                for p in rule.partners(s):
                    k = rule.need(s, p)
                    if p > small or k > min(s, p):
                        continue
                    if k not in hashed:
                        hashed[k] = [xxhash.xxh3_64_intdigest(np.array(c, np.int64).tobytes()) - (1 << 63) for c in itertools.combinations(tokens.tolist(), k)]
                    key += hashed[k]
                    sid += [ident] * len(hashed[k])
                    low += [min(s, p)] * len(hashed[k])
                    high += [max(s, p)] * len(hashed[k])
            yield pd.DataFrame({"sid": sid, "low": pd.array(low, "int32"), "high": pd.array(high, "int32"), "k": pd.array(key, "int64")})

    return run


def _small_pairs(sets: DataFrame, rule: SizeRule, small: int) -> DataFrame:
    keys = sets.where(F.size("tokens") <= small).select("sid", "tokens")
    keys = keys.mapInPandas(_subset_keys(rule, small), "sid binary, low int, high int, k bigint")
    other = keys.select(F.col("sid").alias("other"), "low", "high", "k")
    return keys.join(other, ["low", "high", "k"]).where(F.col("sid") < F.col("other")).select(F.col("sid").alias("sa"), F.col("other").alias("sb"))


def ranked_tokens(sets: DataFrame) -> DataFrame:
    """``(sid, size, ranked)``: each set's tokens as ``(df, token)``, the rarest first."""
    rows = sets.select("sid", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    held = rows.groupBy("token").agg(F.count("*").alias("df"))
    return rows.join(held, "token").groupBy("sid").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))


def _run_lengths(rule: SizeRule, most: int):
    """For a set's size the numbers of tokens that its combinations have: one for each size of a partner as large or larger.

    Two sets meet over combinations of the length that suits the larger one; larger sets never ask for longer ones.
    """

    @lru_cache(maxsize=None)
    def suits(size: int) -> int:
        spare = size - ceil(rule.t * size)
        return max((r for r in range(1, most + 1) if comb(spare + r, r) <= HOT_KEYS), default=1)

    return lru_cache(maxsize=None)(lambda size: tuple(range(suits(floor(size / rule.t)), suits(size) + 1)))


def _list_keys(rule: SizeRule, most: int, hot: int):
    """Emit the inverted-list keys of each set: its rarest tokens, or combinations where the tokens are frequent.

    A result shares at least ``c = ceil(t * size)`` tokens of each side, so it shares one of the first ``s - c + 1``.
    If the first token shared is frequent, so are all later ones; the first ``r`` shared ones then lie within the first
    ``s - c + r`` tokens of both sides. No two sets of the scan share fewer than ``most``.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = _run_lengths(rule, most)
        for batch in batches:
            sid, size, key = [], [], []
            for ident, s, ranked in zip(batch["sid"], batch["size"], batch["ranked"]):
                c = ceil(rule.t * s)
                prefix = [x["token"] for x in ranked if x["df"] <= hot][: s - c + 1]
                keys = [xxhash.xxh3_64_intdigest(t.to_bytes(8, "little", signed=True)) for t in prefix]
                if len(prefix) < s - c + 1:
                    for r in lengths(s):
                        frequent = [x["token"] for x in ranked[: s - c + r] if x["df"] > hot]
                        keys += [xxhash.xxh3_64_intdigest(np.array(x, np.int64).tobytes(), seed=r) for x in itertools.combinations(frequent, r)]
                key += [k - (1 << 63) for k in keys]
                sid += [ident] * len(keys)
                size += [s] * len(keys)
            yield pd.DataFrame({"sid": sid, "size": pd.array(size, "int32"), "k": pd.array(key, "int64")})

    return run


def _large_pairs(sets: DataFrame, rule: SizeRule, small: int) -> DataFrame:
    reach = ceil(rule.t * (small + 1))
    ranked = ranked_tokens(sets.where(F.size("tokens") >= reach))
    keys = ranked.mapInPandas(_list_keys(rule, min(HOT_RUN, rule.need(reach, reach)), HOT_LEAST), "sid binary, size int, k bigint")
    t = float(rule.t)
    other = keys.select(F.col("sid").alias("other"), F.col("size").alias("other_size"), "k")
    close = (F.least("size", "other_size") >= F.greatest("size", "other_size") * F.lit(t) - 1e-9) & (F.greatest("size", "other_size") > small)
    return keys.join(other, "k").where((F.col("sid") < F.col("other")) & close).select(F.col("sid").alias("sa"), F.col("other").alias("sb"))


def distinct_set_pairs(sets: DataFrame, threshold: float = THRESHOLD, budget: int = SUBSET_BUDGET) -> DataFrame:
    """``(sa, sb, overlap, jaccard)`` over distinct sets ``(sid, tokens)``: all pairs that reach the threshold."""
    rule = SizeRule(threshold)
    small = rule.largest_small(budget)
    found = _small_pairs(sets, rule, small).unionByName(_large_pairs(sets, rule, small)).distinct()
    a = sets.select(F.col("sid").alias("sa"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("sid").alias("sb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    either = F.size("ta") + F.size("tb") - F.col("overlap")
    num, den = rule.t.numerator, rule.t.denominator
    return (
        found.join(a, "sa")
        .join(b, "sb")
        .withColumn("overlap", both)
        .where(F.col("overlap").cast("bigint") * den >= either.cast("bigint") * num)
        .select("sa", "sb", "overlap", (F.col("overlap") / either).alias("jaccard"))
    )


def similar_sets(records: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``members(id, sid)`` and ``links(sa, sb, overlap, jaccard)`` over records ``(id, tokens)``.

    Records with equal sets share a ``sid`` and need no link; each pair of different sets that reaches the threshold is
    one link. Together they hold every similar pair without writing the pairs among equal sets.
    """
    scratch = Scratch(records.sparkSession, "setjoin")
    keyed = scratch.cut(records.select("id", set_key().alias("sid"), "tokens"), "keyed")
    sets = scratch.cut(keyed.groupBy("sid").agg(F.first("tokens").alias("tokens")), "sets")
    links = scratch.cut(distinct_set_pairs(sets, threshold), "links")
    scratch.drop(sets)
    return keyed.select("id", "sid"), links


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of ids ``(a, b, jaccard)``, ``a < b``: those of equal sets, and those over each link."""
    left, right = members.select(F.col("id").alias("a"), F.col("sid").alias("sa")), members.select(F.col("id").alias("b"), F.col("sid").alias("sb"))
    equal = left.join(right, left.sa == right.sb).where(F.col("a") < F.col("b")).select("a", "b", F.lit(1.0).alias("jaccard"))
    linked = links.join(left, "sa").join(right, "sb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
    return equal.unionByName(linked)


def rule_pairs(css_rules: DataFrame, library_rules: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(rule_a, rule_b, jaccard)`` over both tables together, ``rule_a < rule_b``.

    Defined cases: null features, null elements and repeated values are dropped before comparing; rules with fewer
    than three values, and rules without an id, take no part; a rule delivered twice counts once; empty tables give no
    rows; extra columns are ignored.
    """
    both = css_rules.select("rule_id", "features").unionByName(library_rules.select("rule_id", "features"))
    members, links = similar_sets(record_sets(both, "rule_id"), threshold)
    return expand_pairs(members, links).select(F.col("a").alias("rule_a"), F.col("b").alias("rule_b"), "jaccard")


def rule_classes(css_rules: DataFrame, library_rules: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(rule_id, class_id, links)``: a rule's set as the smallest rule that has it, and how many other sets it meets."""
    both = css_rules.select("rule_id", "features").unionByName(library_rules.select("rule_id", "features"))
    members, links = similar_sets(record_sets(both, "rule_id"), threshold)
    degree = links.select(F.explode(F.array("sa", "sb")).alias("sid")).groupBy("sid").agg(F.count("*").alias("links"))
    classes = members.groupBy("sid").agg(F.min("id").alias("class_id")).join(degree, "sid", "left")
    return members.join(classes, "sid").select(F.col("id").alias("rule_id"), "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))

"""The audit's operators as queries over the given tables, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.config import CODE_EXTENSIONS, IGNORE, Structure
from twinsift.functions import scalar
from twinsift.functions.globs import globs_to_regex
from twinsift.operators import baseline, calibrate, lines, reach, similarity, tokens
from twinsift.operators.resolve import resolve_specifiers
from twinsift.operators.ted import confirm_trees
from twinsift.session import table
from twinsift.sources import css, script
from twinsift.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each file: deliveries of the same file are equal but for their time."""
    rows = table(spark, folder, "source_files").where("file_id IS NOT NULL")
    return rows.groupBy("file_id").agg(*[F.max(c).alias(c) for c in ("repo", "path", "text", "ord", "excluded")])


_FILES = "f AS (SELECT file_id, max(repo) AS repo, max(path) AS path, max(text) AS text, max(ord) AS ord, max(excluded) AS excluded FROM source_files WHERE file_id IS NOT NULL GROUP BY file_id)"
_UNITS = "u AS (SELECT unit_id, max(file_id) AS file_id, max(repo) AS repo, max(path) AS path, max(name) AS name, max(start_line) AS start_line, max(end_line) AS end_line, max(size) AS size, max(normalized) AS normalized, max(raw) AS raw, max(list_sort(list_distinct(list_filter(features, lambda x: x IS NOT NULL)))) AS features FROM units WHERE unit_id IS NOT NULL GROUP BY unit_id)"
_RULES = _UNITS.replace("unit_id", "rule_id").replace("FROM units", "FROM css_rules").replace("max(size) AS size, ", "").replace("max(normalized) AS normalized, max(raw) AS raw", "max(normalized_key) AS normalized, max(raw_key) AS raw").replace("u AS", "r AS", 1)


def _keyed(spark: SparkSession, folder: str, name: str, key: str, columns: dict[str, str]) -> DataFrame:
    rows = table(spark, folder, name).where(F.col(key).isNotNull())
    values = F.array_sort(F.array_distinct(F.filter("features", lambda x: x.isNotNull())))
    return rows.groupBy(key).agg(*[F.max(old).alias(new) for new, old in columns.items()], F.max(values).alias("features"))


def units(spark: SparkSession, folder: str) -> DataFrame:
    return _keyed(spark, folder, "units", "unit_id", {c: c for c in ("file_id", "repo", "path", "name", "start_line", "end_line", "size", "normalized", "raw")})


def rules(spark: SparkSession, folder: str) -> DataFrame:
    return _keyed(spark, folder, "css_rules", "rule_id", {**{c: c for c in ("file_id", "repo", "path", "name", "start_line", "end_line")}, "normalized": "normalized_key", "raw": "raw_key"})


# -- inventory -----------------------------------------------------------------------------------------------------

_LINES = "CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END"


@query(f"WITH {_FILES} SELECT file_id, CAST({_LINES} AS INTEGER) AS lines FROM f")
def line_counts(spark, folder):
    return files(spark, folder).select("file_id", scalar.count_lines(F.col("text")).alias("lines"))


@query(f"WITH {_FILES} SELECT lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, count(*) AS files, CAST(sum({_LINES}) AS BIGINT) AS lines FROM f GROUP BY 1")
def extension_totals(spark, folder):
    return files(spark, folder).groupBy(scalar.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"), F.sum(scalar.count_lines(F.col("text"))).alias("lines"))


@query(f"WITH {_FILES} SELECT file_id, coalesce(excluded, false) OR regexp_matches(path, '{globs_to_regex(IGNORE)}') AS excluded FROM f WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ({', '.join(repr(e) for e in CODE_EXTENSIONS)})")
def ignored_files(spark, folder):
    own = files(spark, folder).where(scalar.extension(F.col("path")).isin(*CODE_EXTENSIONS))
    return own.select("file_id", (F.coalesce("excluded", F.lit(False)) | F.col("path").rlike(globs_to_regex(IGNORE))).alias("excluded"))


@query(f"WITH {_FILES} SELECT coalesce(excluded, false) AS excluded, count(*) AS files, CAST(sum({_LINES}) AS BIGINT) AS lines FROM f GROUP BY 1")
def excluded_summary(spark, folder):
    return files(spark, folder).groupBy(F.coalesce("excluded", F.lit(False)).alias("excluded")).agg(F.count("*").alias("files"), F.sum(scalar.count_lines(F.col("text"))).alias("lines"))


@query(f"WITH {_FILES} SELECT file_id FROM f WHERE regexp_matches(path, '{scalar.TEST_PATH}')")
def test_files(spark, folder):
    return files(spark, folder).where(scalar.is_test_path(F.col("path"))).select("file_id")


@query(f"WITH {_FILES} SELECT file_id, regexp_replace(path, '\\.[^./]+$', '') AS bare, list_extract(string_split(regexp_replace(path, '\\.[^./]+$', ''), '/'), -1) AS base FROM f")
def path_needles(spark, folder):
    bare = scalar.without_extension(F.col("path"))
    return files(spark, folder).select("file_id", bare.alias("bare"), scalar.base_name(bare).alias("base"))


# -- copies --------------------------------------------------------------------------------------------------------


@query(f"WITH {_FILES} SELECT md5(text) AS digest, count(*) AS files, min(file_id) AS head FROM f WHERE text <> '' GROUP BY text HAVING count(*) > 1")
def exact_copies(spark, folder):
    rows = files(spark, folder).where("text <> ''").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("files"), F.min("file_id").alias("head"))
    return rows.where("files > 1")


@query(
    f"WITH {_UNITS} SELECT md5(normalized) AS key, count(*) AS members, min(unit_id) AS head, CASE WHEN count(DISTINCT raw) = 1 THEN 'identical' ELSE 'normalized' END AS kind FROM u WHERE normalized IS NOT NULL GROUP BY normalized HAVING count(*) > 1"
)
def unit_groups(spark, folder):
    grouped = units(spark, folder).where("normalized IS NOT NULL").groupBy("normalized").agg(F.count("*").alias("members"), F.min("unit_id").alias("head"), F.count_distinct("raw").alias("raws"))
    return grouped.where("members > 1").select(F.md5("normalized").alias("key"), "members", "head", F.when(F.col("raws") == 1, "identical").otherwise("normalized").alias("kind"))


@query(f"WITH {_UNITS} SELECT unit_id, min(unit_id) OVER (PARTITION BY normalized) AS head FROM u WHERE normalized IS NOT NULL")
def representatives(spark, folder):
    return similarity.exact_groups(units(spark, folder), "normalized", "unit_id").select("unit_id", "head")


@query(f"WITH {_UNITS} SELECT f AS feature, count(*) AS held FROM (SELECT unit_id, unnest(features) AS f FROM u) GROUP BY f")
def posting_lengths(spark, folder):
    return similarity.postings(units(spark, folder), "unit_id").groupBy("feature").agg(F.count("*").alias("held"))


#: The audit's cut: of the groups of equal normalised keys the first units are compared, over features that few of these hold.
_CANDIDATES = f"""
WITH {_UNITS}, h AS (SELECT * FROM (SELECT *, min(unit_id) OVER (PARTITION BY normalized) AS head FROM u WHERE normalized IS NOT NULL) WHERE unit_id = head),
p AS (SELECT unit_id, unnest(features) AS f FROM h), kept AS (SELECT f FROM p GROUP BY f HAVING count(*) <= 64),
k AS (SELECT p.* FROM p JOIN kept USING (f)), s AS (SELECT unit_id, count(*) AS n FROM k GROUP BY 1),
met AS (SELECT x.unit_id AS a, y.unit_id AS b, count(*) AS overlap FROM k x JOIN k y ON x.f = y.f AND x.unit_id < y.unit_id GROUP BY 1, 2),
c AS (SELECT a, b, overlap, overlap / (sa.n + sb.n - overlap) AS jaccard, sa.n AS na, sb.n AS nb FROM met JOIN s sa ON sa.unit_id = a JOIN s sb ON sb.unit_id = b)
"""


def _heads(spark: SparkSession, folder: str) -> DataFrame:
    own = units(spark, folder)
    return own.join(similarity.exact_groups(own, "normalized", "unit_id").where("unit_id = head").select("unit_id"), "unit_id", "left_semi")


@query(_CANDIDATES + "SELECT a, b, overlap, jaccard FROM c WHERE jaccard >= 0.4")
def candidate_pairs(spark, folder):
    return similarity.candidate_pairs(_heads(spark, folder), 0.4, 64, "unit_id")


_SIMILAR_RULES = f"""
{_RULES}, e AS (SELECT rule_id, len(features) AS n, unnest(features) AS f FROM r WHERE len(features) > 0),
pairs AS (SELECT x.rule_id AS a, y.rule_id AS b, count(*) AS overlap, count(*) / (any_value(x.n + y.n) - count(*)) AS jaccard FROM e x JOIN e y ON x.f = y.f AND x.rule_id < y.rule_id GROUP BY 1, 2)
"""


@query(f"WITH {_SIMILAR_RULES} SELECT a, b, overlap, jaccard FROM pairs WHERE jaccard >= 0.85")
def rule_candidates(spark, folder):
    """Without a posting cut: the prefix filter keeps the join small, and exact."""
    return similarity.candidate_pairs(rules(spark, folder).select(F.col("rule_id").alias("id"), "features"), 0.85)


@query(_CANDIDATES + ", z AS (SELECT c.*, ua.size AS sa, ub.size AS sb FROM c JOIN u ua ON ua.unit_id = a JOIN u ub ON ub.unit_id = b) SELECT a, b, least(sa, sb) / greatest(sa, sb) AS bound FROM z WHERE jaccard >= 0.4 AND greatest(sa, sb) > 0 AND least(sa, sb) / greatest(sa, sb) >= 0.85")
def comparable_pairs(spark, folder):
    """Candidates whose sizes leave room for the threshold."""
    own = _heads(spark, folder)
    pairs = similarity.candidate_pairs(own, 0.4, 64, "unit_id")
    for side in "ab":
        pairs = pairs.join(own.select(F.col("unit_id").alias(side), F.col("size").alias(f"s{side}")), side)
    bound = scalar.size_ratio(F.col("sa"), F.col("sb"))
    return pairs.where(F.greatest("sa", "sb") > 0).select("a", "b", bound.alias("bound")).where("bound >= 0.85")


#: Units of equal features and size are one group, so a copy held by many is compared once; no feature is cut.
_WHOLE = f"""
WITH {_UNITS}, g AS (SELECT unit_id, size, features, min(unit_id) OVER (PARTITION BY features, size) AS head FROM u WHERE len(features) > 0),
e AS (SELECT unit_id, size, len(features) AS n, unnest(features) AS f FROM g WHERE unit_id = head),
c AS (SELECT x.unit_id AS a, y.unit_id AS b, count(*) AS overlap, count(*) / (any_value(x.n + y.n) - count(*)) AS jaccard, any_value(x.size) AS sa, any_value(y.size) AS sb FROM e x JOIN e y ON x.f = y.f AND x.unit_id < y.unit_id GROUP BY 1, 2)
"""


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    own = units(spark, folder).where(F.size("features") > 0)
    return own.select("unit_id", "size", "features", F.min("unit_id").over(Window.partitionBy("features", "size")).alias("head"))


@query(_WHOLE + "SELECT unit_id, head FROM g")
def candidate_groups(spark, folder):
    """The group each unit is compared in, by its first unit: two units of one group are alike in features and size."""
    return _groups(spark, folder).select("unit_id", "head")


@query(_WHOLE + "SELECT a, b, overlap, jaccard FROM c WHERE jaccard >= 0.4")
def whole_candidate_pairs(spark, folder):
    """``candidate_pairs`` without its cut: groups by their first units, over all features, through the prefix filter."""
    return similarity.candidate_pairs(_groups(spark, folder).where("unit_id = head"), 0.4, None, "unit_id")


@query(_WHOLE + "SELECT a, b, least(sa, sb) / greatest(sa, sb) AS bound FROM c WHERE jaccard >= 0.4 AND greatest(sa, sb) > 0 AND least(sa, sb) / greatest(sa, sb) >= 0.85")
def whole_comparable_pairs(spark, folder):
    heads = _groups(spark, folder).where("unit_id = head")
    pairs = similarity.candidate_pairs(heads, 0.4, None, "unit_id")
    for side in "ab":
        pairs = pairs.join(heads.select(F.col("unit_id").alias(side), F.col("size").alias(f"s{side}")), side)
    bound = scalar.size_ratio(F.col("sa"), F.col("sb"))
    return pairs.where(F.greatest("sa", "sb") > 0).select("a", "b", bound.alias("bound")).where("bound >= 0.85")


def _clusters(frame: DataFrame, key: str, kind_only: bool = False) -> tuple[DataFrame, DataFrame]:
    ready = frame.where("normalized IS NOT NULL").select(F.col(key).alias("ord"), "normalized", "raw", F.coalesce("features", F.expr("cast(array() as array<int>)")).alias("features"))
    return similarity.cluster_units(ready, 0.85, 0.85)


_RULE_CLUSTERS = f"""
WITH RECURSIVE {_RULES}, k AS (SELECT rule_id, normalized, coalesce(raw, '') AS raw, coalesce(features, []) AS features, min(rule_id) OVER (PARTITION BY normalized) AS head FROM r WHERE normalized IS NOT NULL),
h AS (SELECT * FROM k WHERE rule_id = head), e AS (SELECT rule_id, len(features) AS n, unnest(features) AS f FROM h WHERE len(features) > 0),
link AS (SELECT * FROM (SELECT x.rule_id AS a, y.rule_id AS b, count(*) / (any_value(x.n + y.n) - count(*)) AS similarity FROM e x JOIN e y ON x.f = y.f AND x.rule_id < y.rule_id GROUP BY 1, 2) WHERE similarity >= 0.85),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
walk(id, low) AS (SELECT head, head FROM h UNION SELECT w.b, walk.low FROM walk JOIN both_ways w ON w.a = walk.id WHERE walk.low < w.b),
c AS (SELECT id, min(low) AS cluster FROM walk GROUP BY id),
m AS (SELECT k.*, c.cluster FROM k JOIN c ON c.id = k.head),
weak AS (SELECT c.cluster, min(similarity) AS weakest FROM link JOIN c ON c.id = link.a GROUP BY 1),
g AS (SELECT m.cluster, count(*) AS members, count(DISTINCT head) AS heads, count(DISTINCT raw) AS raws, any_value(weakest) AS weakest FROM m LEFT JOIN weak USING (cluster) GROUP BY 1 HAVING count(*) >= 2)
"""


@query(_RULE_CLUSTERS + "SELECT cluster, CASE WHEN heads > 1 THEN 'near-miss' WHEN raws = 1 THEN 'identical' ELSE 'normalized' END AS kind, CASE WHEN heads > 1 THEN weakest ELSE 1.0 END AS similarity, members FROM g")
def rule_clusters(spark, folder):
    return _clusters(rules(spark, folder), "rule_id")[0]


@query(_RULE_CLUSTERS + "SELECT m.cluster, rule_id FROM m JOIN g USING (cluster)")
def rule_cluster_members(spark, folder):
    return _clusters(rules(spark, folder), "rule_id")[1].select("cluster", F.col("ord").alias("rule_id"))


_LINKS = "l AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b AND similarity >= 0.95 AND similarity <= 1), s AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l)"


@query(f"WITH RECURSIVE {_LINKS}, w(id, low) AS (SELECT a, a FROM s UNION SELECT s.b, w.low FROM w JOIN s ON s.a = w.id WHERE w.low < s.b) SELECT id, min(low) AS component FROM w GROUP BY id")
def linked_units(spark, folder):
    """Connected components over the links of at least 0.95."""
    edges = table(spark, folder, "edges").where("a <> b AND similarity >= 0.95 AND similarity <= 1")
    return similarity.components(edges)


# -- lines ---------------------------------------------------------------------------------------------------------

_SPANS = "sp AS (SELECT DISTINCT path, start_line, end_line FROM (SELECT source_id_a AS path, start_line_a AS start_line, end_line_a AS end_line FROM token_clones UNION ALL SELECT source_id_b, start_line_b, end_line_b FROM token_clones) WHERE path IS NOT NULL AND start_line <= end_line)"


@query(
    f"""WITH {_SPANS}, o AS (SELECT *, max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT path, min(start_line) AS start_line, max(end_line) AS end_line FROM i GROUP BY path, island"""
)
def interval_union(spark, folder):
    return lines.span_islands(_sides(spark, folder), "path")


def _sides(spark: SparkSession, folder: str) -> DataFrame:
    clones = table(spark, folder, "token_clones")
    sides = [clones.select("clone_id", F.lit(x).alias("side"), F.col(f"source_id_{x}").alias("path"), F.col(f"start_line_{x}").alias("start_line"), F.col(f"end_line_{x}").alias("end_line")) for x in "ab"]
    return sides[0].unionByName(sides[1]).where("path IS NOT NULL")


def _members(spark: SparkSession, folder: str) -> DataFrame:
    placed = table(spark, folder, "clone_clusters").select(F.col("cluster_id").alias("cluster"), F.posexplode("locations").alias("member", "l"))
    return placed.select("cluster", "member", "l.path", "l.start_line", "l.end_line", "l.name").where("path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL")


_MEMBERS = "m AS (SELECT * FROM (SELECT cluster, member, l.path AS path, l.start_line AS start_line, l.end_line AS end_line, l.name AS name FROM (SELECT cluster_id AS cluster, unnest(range(0, len(locations))) AS member, unnest(locations) AS l FROM clone_clusters)) WHERE path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL)"
_LATER = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY path, start_line, end_line) AS place FROM m) WHERE place > 1)"


@query(f"WITH {_MEMBERS}, {_LATER} SELECT cluster, CAST(sum(end_line - start_line + 1) AS BIGINT) AS savable FROM t GROUP BY cluster")
def savable_lines(spark, folder):
    return lines.savable_lines(_members(spark, folder))


@query(
    f"""WITH {_MEMBERS}, {_LATER}, sp AS (SELECT DISTINCT path, start_line, end_line FROM t WHERE start_line <= end_line),
n AS (SELECT DISTINCT path, unnest(range(start_line, end_line + 1)) AS line FROM sp) SELECT count(*) AS duplicated_lines FROM n"""
)
def duplicated_lines(spark, folder):
    return lines.duplicated_lines(_members(spark, folder))


@query(f"WITH {_MEMBERS}, {_LATER}, s AS (SELECT cluster, CAST(sum(end_line - start_line + 1) AS BIGINT) AS savable FROM t GROUP BY cluster) SELECT cluster, savable FROM s ORDER BY savable DESC, cluster LIMIT 10")
def top_clusters(spark, folder):
    return lines.savable_lines(_members(spark, folder)).orderBy(F.desc("savable"), "cluster").limit(10)


_PAIRS = "p AS (SELECT clone_id AS pair, source_id_a AS path_a, start_line_a AS start_a, end_line_a AS end_a, source_id_b AS path_b, start_line_b AS start_b, end_line_b AS end_b FROM token_clones)"
_EXPLAINED = "x AS (SELECT DISTINCT pair FROM p JOIN m1 ON p.path_a = m1.path AND m1.start_line <= start_a AND m1.end_line >= end_a JOIN m1 m2 ON p.path_b = m2.path AND m2.start_line <= start_b AND m2.end_line >= end_b AND m1.cluster = m2.cluster AND m1.member <> m2.member)"
#: Functions found again are the places that explain clones: units with one normalised key, as members of one cluster.
_PLACES = f"{_UNITS}, m1 AS (SELECT min(unit_id) OVER (PARTITION BY normalized) AS cluster, unit_id AS member, repo || '/' || path AS path, start_line, end_line FROM u WHERE normalized IS NOT NULL)"


def _places(spark: SparkSession, folder: str) -> DataFrame:
    own = units(spark, folder).where("normalized IS NOT NULL")
    head = F.min("unit_id").over(Window.partitionBy("normalized"))
    return own.select(head.alias("cluster"), F.col("unit_id").alias("member"), F.concat("repo", F.lit("/"), "path").alias("path"), "start_line", "end_line")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    clones = table(spark, folder, "token_clones")
    return clones.select(F.col("clone_id").alias("pair"), *[F.col(f"{c}_{x}").alias(f"{k}_{x}") for x in "ab" for c, k in (("source_id", "path"), ("start_line", "start"), ("end_line", "end"))])


@query(f"WITH {_PLACES}, {_PAIRS}, {_EXPLAINED} SELECT p.pair FROM p WHERE pair NOT IN (SELECT pair FROM x)")
def unexplained_pairs(spark, folder):
    return lines.unexplained_pairs(_pairs(spark, folder), _places(spark, folder)).select("pair")


@query(f"WITH {_PLACES}, {_PAIRS} SELECT p.pair, m1.cluster, m1.member FROM p JOIN m1 ON p.path_a = m1.path AND m1.start_line <= start_a AND m1.end_line >= end_a")
def enclosing_units(spark, folder):
    return lines.enclosed_sides(_pairs(spark, folder), _places(spark, folder), "a")


_COVER = f"{_FILES}, a AS (SELECT repo || '/' || path AS path, {_LINES} AS lines, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext FROM f WHERE text IS NOT NULL), bad AS (SELECT DISTINCT repo || '/' || path AS path FROM failures WHERE repo IS NOT NULL AND path IS NOT NULL)"


def _covered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    place = F.concat("repo", F.lit("/"), "path")
    own = files(spark, folder).where("text IS NOT NULL").select(place.alias("path"), scalar.count_lines(F.col("text")).alias("lines"), scalar.extension(F.col("path")).alias("ext"))
    bad = table(spark, folder, "failures").select(place.alias("path")).where("path IS NOT NULL")
    return own, own.select("path").join(bad, "path", "left_anti")


@query(f"WITH {_COVER} SELECT CAST(sum(CASE WHEN path NOT IN (SELECT path FROM bad) THEN lines ELSE 0 END) AS BIGINT) AS covered_lines, CAST(sum(lines) AS BIGINT) AS total_lines, sum(CASE WHEN path NOT IN (SELECT path FROM bad) THEN lines ELSE 0 END) * 100.0 / sum(lines) AS percent FROM a")
def coverage(spark, folder):
    return lines.coverage(*_covered(spark, folder))


@query(f"WITH {_COVER} SELECT ext, CAST(sum(lines) AS BIGINT) AS lines FROM a WHERE path IN (SELECT path FROM bad) GROUP BY ext")
def uncovered_by_extension(spark, folder):
    return lines.uncovered_by_extension(*_covered(spark, folder))


@query(
    f"""WITH {_COVER}, {_MEMBERS}, {_LATER}, n AS (SELECT DISTINCT path, unnest(range(start_line, end_line + 1)) AS line FROM t WHERE start_line <= end_line),
v AS (SELECT sum(CASE WHEN path NOT IN (SELECT path FROM bad) THEN lines ELSE 0 END) AS covered, sum(lines) AS total FROM a),
g AS (SELECT 'coverage' AS gate, 90.0 AS "limit", covered * 100.0 / total AS actual FROM v UNION ALL SELECT 'duplication', 5.0, (SELECT count(*) FROM n) * 100.0 / covered FROM v)
SELECT gate, CAST("limit" AS DOUBLE) AS "limit", actual, CASE WHEN gate = 'coverage' THEN actual >= "limit" ELSE actual <= "limit" END AS passed FROM g"""
)
def gates(spark, folder):
    seen = lines.coverage(*_covered(spark, folder))
    both = seen.crossJoin(F.broadcast(lines.duplicated_lines(_members(spark, folder))))  # one row each
    share = lines.duplication_percent(F.col("duplicated_lines"), F.col("covered_lines"))
    rows = both.select(F.explode(F.array(F.struct(F.lit("coverage").alias("gate"), F.lit(90.0).alias("limit"), F.col("percent").cast("double").alias("actual")), F.struct(F.lit("duplication").alias("gate"), F.lit(5.0).alias("limit"), share.cast("double").alias("actual")))).alias("g")).select("g.*")
    return rows.withColumn("passed", F.when(F.col("gate") == "coverage", F.col("actual") >= F.col("limit")).otherwise(F.col("actual") <= F.col("limit")))


@query("SELECT lower(detector) AS detector, replace(replace(lower(kind), '_', '-'), ' ', '-') AS kind, count(*) AS clusters, CAST(sum(len(locations)) AS BIGINT) AS places FROM clone_clusters GROUP BY 1, 2")
def clusters_by_detector(spark, folder):
    kind = F.replace(F.replace(F.lower("kind"), F.lit("_"), F.lit("-")), F.lit(" "), F.lit("-"))
    return table(spark, folder, "clone_clusters").groupBy(F.lower("detector").alias("detector"), kind.alias("kind")).agg(F.count("*").alias("clusters"), F.sum(F.size("locations")).cast("bigint").alias("places"))


# -- baseline ------------------------------------------------------------------------------------------------------

_HASHED = f"{_FILES}, {_UNITS}, h AS (SELECT u.*, sha256(u.path || chr(10) || array_to_string(list_slice(string_split(replace(f.text, chr(13) || chr(10), chr(10)), chr(10)), start_line, end_line), chr(10))) AS digest FROM u LEFT JOIN f USING (file_id))"


def _unit_hashes(spark: SparkSession, folder: str) -> DataFrame:
    own = units(spark, folder).join(files(spark, folder).select("file_id", "text"), "file_id", "left")
    return own.select("unit_id", "repo", "path", "normalized", scalar.member_hash(F.col("path"), F.col("text"), F.col("start_line"), F.col("end_line")).alias("digest"))


@query(f"WITH {_HASHED} SELECT unit_id, coalesce(digest, 'missing:' || path || ':' || start_line || '-' || end_line) AS digest FROM h WHERE start_line >= 1")
def member_fingerprints(spark, folder):
    return _unit_hashes(spark, folder).select("unit_id", "digest")


_PRINTS = "g AS (SELECT min(unit_id) AS head, sha256('structure|normalized|' || string_agg(coalesce(digest, 'missing:' || path || ':' || start_line || '-' || end_line), '|' ORDER BY coalesce(digest, 'missing:' || path || ':' || start_line || '-' || end_line))) AS fingerprint, min(repo) AS repo FROM h WHERE normalized IS NOT NULL GROUP BY normalized HAVING count(*) > 1)"


def _prints(spark: SparkSession, folder: str) -> DataFrame:
    hashed = _unit_hashes(spark, folder).where("normalized IS NOT NULL")
    joined = hashed.groupBy("normalized").agg(F.min("unit_id").alias("head"), F.min("repo").alias("repo"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("digest")), "|").alias("hs")).where("n > 1")
    return joined.select("head", "repo", F.sha2(F.concat_ws("|", F.lit("structure"), F.lit("normalized"), "hs"), 256).alias("fingerprint"))


@query(f"WITH {_HASHED}, {_PRINTS} SELECT head, fingerprint FROM g")
def cluster_fingerprints(spark, folder):
    return _prints(spark, folder).select("head", "fingerprint")


@query(f"WITH {_HASHED}, {_PRINTS} SELECT head, fingerprint FROM g WHERE fingerprint NOT IN (SELECT fingerprint FROM g WHERE repo < 'k')")
def baseline_new(spark, folder):
    """Clusters that a baseline of the repositories before 'k' does not know."""
    prints = _prints(spark, folder)
    return baseline.split_against(prints, prints.where("repo < 'k'"))[0].select("head", "fingerprint")


@query(f"WITH {_HASHED}, {_PRINTS} SELECT head, fingerprint FROM g WHERE fingerprint IN (SELECT fingerprint FROM g WHERE repo < 'k')")
def baseline_known(spark, folder):
    prints = _prints(spark, folder)
    return baseline.split_against(prints, prints.where("repo < 'k'"))[1].select("head", "fingerprint")


# -- graphs --------------------------------------------------------------------------------------------------------

#: Every customer is an entry.
_GRAPH = """arc AS (
  SELECT 'c' || c_custkey AS src, 'o' || o_orderkey AS dst FROM customer JOIN orders ON c_custkey = o_custkey
  UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem),
start AS (SELECT 'c' || c_custkey AS id FROM customer),
live(id) AS (SELECT id FROM start UNION SELECT dst FROM live JOIN arc ON arc.src = live.id)"""


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    customer, orders, lineitem = (table(spark, folder, t) for t in ("customer", "orders", "lineitem"))
    arcs = customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).select(key("c", "c_custkey").alias("src"), key("o", "o_orderkey").alias("dst"))
    for letter, column in (("p", "l_partkey"), ("s", "l_suppkey")):
        arcs = arcs.unionByName(lineitem.select(key("o", "l_orderkey").alias("src"), key(letter, column).alias("dst")).distinct())
    return arcs, customer.select(key("c", "c_custkey").alias("id"))


#: The customers of one whole market segment are the entries.
_SEGMENT = _GRAPH.replace("FROM customer)", "FROM customer WHERE c_mktsegment = 'BUILDING')")


def _segment(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    arcs, _ = _graph(spark, folder)
    own = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'")
    return arcs, own.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))


@query(f"WITH RECURSIVE {_SEGMENT} SELECT id FROM live")
def reachable(spark, folder):
    """What the orders of the segment's customers lead to."""
    return reach.reachable(*_segment(spark, folder))


@query(f"WITH RECURSIVE {_SEGMENT} SELECT id FROM (SELECT 'p' || p_partkey AS id FROM part UNION ALL SELECT 'o' || o_orderkey FROM orders) WHERE id NOT IN (SELECT id FROM live)")
def dead_nodes(spark, folder):
    """Orders and parts that no customer of the segment leads to."""
    parts = table(spark, folder, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    placed = table(spark, folder, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    return reach.dead_nodes(parts.unionByName(placed), reach.reachable(*_segment(spark, folder)))


@query(f"WITH RECURSIVE {_GRAPH} SELECT id FROM live")
def whole_reachable(spark, folder):
    """What the orders of all customers lead to."""
    return reach.reachable(*_graph(spark, folder))


@query(f"WITH RECURSIVE {_GRAPH} SELECT 'p' || p_partkey AS id FROM part WHERE 'p' || p_partkey NOT IN (SELECT id FROM live)")
def whole_dead_nodes(spark, folder):
    """Parts that no customer's order reaches."""
    parts = table(spark, folder, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return reach.dead_nodes(parts, reach.reachable(*_graph(spark, folder)))


_IMPORTS = f"""{_FILES}, imp AS (SELECT repo, path AS src, unnest(regexp_extract_all(text, '(?:from|import|require\\()\\s*[''"](\\.[^''"]+)[''"]', 1)) AS specifier FROM f WHERE text IS NOT NULL)"""


def _imports(spark: SparkSession, folder: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("""(?:from|import|require\\()\\s*['"](\\.[^'"]+)['"]"""), 1)
    return files(spark, folder).where("text IS NOT NULL").select("repo", F.col("path").alias("src"), F.explode(found).alias("specifier"))


@query(f"WITH {_IMPORTS} SELECT repo, specifier, count(*) AS n FROM imp GROUP BY ALL")
def import_counts(spark, folder):
    return _imports(spark, folder).groupBy("repo", "specifier").agg(F.count("*").alias("n"))


_IMPORTED_CSS = f"WITH {_FILES}, s AS (SELECT file_id, unnest(regexp_extract_all(regexp_replace(text, '/\\*.*?\\*/', '', 'gs'), '@import\\s+(?:url\\(\\s*)?[\"'']?([^\"'')\\s;]+)', 1)) AS s FROM f WHERE path LIKE '%.css' AND text IS NOT NULL)"


@query(_IMPORTED_CSS + " SELECT file_id, CASE WHEN regexp_matches(s, '^(\\.|/|[A-Za-z][A-Za-z0-9+.-]*:)') THEN s ELSE './' || s END AS specifier FROM s")
def css_imports(spark, folder):
    sheets = files(spark, folder).where("path LIKE '%.css' AND text IS NOT NULL")
    return sheets.select("file_id", F.explode(css.imported(F.col("text"))).alias("specifier"))


@query()
def resolved_imports(spark, folder):
    """Specifiers that name a file of their repository, by the ordered list of candidates."""
    return resolve_specifiers(_imports(spark, folder), files(spark, folder).select("repo", "path"), scope="repo").select("repo", "src", "specifier", "dst").distinct()


#: In the order of paths each file asks for two later ones of its repository: without its extension, or by the compiled one; from its own folder or the root.
_ASKED = f"""{_FILES}, d AS (SELECT repo, path, regexp_replace(path, '[^/]*$', '') AS dir, regexp_replace(list_extract(string_split(path, '/'), -1), '\\.[^./]+$', '') AS base, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, row_number() OVER (PARTITION BY repo ORDER BY path) AS place FROM f WHERE repo IS NOT NULL AND path IS NOT NULL),
q AS (SELECT x.repo, x.path AS src, x.dir AS own, y.dir, y.base, y.ext FROM d x JOIN d y ON x.repo = y.repo AND x.place = y.place // 2),
a AS (SELECT DISTINCT repo, src, dir || base AS bare, CASE WHEN dir = own THEN './' ELSE '/' || dir END || base || CASE WHEN ext = '.ts' THEN '.js' ELSE '' END AS specifier, ext FROM q),
c AS (SELECT repo, src, specifier, unnest(CASE WHEN ext = '.ts' THEN ['.js', '.ts', '.tsx', '.jsx'] ELSE ['', '.ts', '.tsx', '.d.ts', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs', '.css', '/index.ts', '/index.tsx', '/index.d.ts', '/index.mts', '/index.cts', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs', '/index.css'] END) AS tail, unnest(CASE WHEN ext = '.ts' THEN range(0, 4) ELSE range(0, 21) END) AS place, bare FROM a),
hit AS (SELECT c.repo, src, specifier, min_by(d.path, c.place) AS dst FROM c JOIN d ON d.repo = c.repo AND d.path = bare || tail GROUP BY ALL)"""


def _siblings(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("path")
    own = files(spark, folder).where("repo IS NOT NULL AND path IS NOT NULL").select(
        "repo", "path", F.regexp_replace("path", "[^/]*$", "").alias("dir"), scalar.base_name(scalar.without_extension(path)).alias("base"), scalar.extension(path).alias("ext"), F.row_number().over(Window.partitionBy("repo").orderBy("path")).alias("place")
    )
    later = own.select("repo", "dir", "base", "ext", (F.floor(F.col("place") / 2)).alias("place"))
    asked = own.select("repo", path.alias("src"), F.col("dir").alias("own"), "place").join(later, ["repo", "place"])
    start = F.when(F.col("dir") == F.col("own"), "./").otherwise(F.concat(F.lit("/"), "dir"))
    return asked.select("repo", "src", F.concat(start, "base", F.when(F.col("ext") == ".ts", ".js").otherwise("")).alias("specifier")).distinct()


@query(f"WITH {_ASKED} SELECT repo, src, specifier, dst FROM hit WHERE src <> dst")
def resolved_siblings(spark, folder):
    """Specifiers resolved by the ordered candidates: the path itself, the source of a compiled name, extensions, index files."""
    return resolve_specifiers(_siblings(spark, folder), files(spark, folder).select("repo", "path"), scope="repo").select("repo", "src", "specifier", "dst")


@query(f"WITH RECURSIVE {_ASKED}, live(repo, path) AS (SELECT repo, min(path) FROM d GROUP BY repo UNION SELECT hit.repo, hit.dst FROM live JOIN hit ON hit.repo = live.repo AND hit.src = live.path) SELECT repo, path FROM live")
def module_graph(spark, folder):
    """The files that each repository's first file leads to over resolved specifiers."""
    place = lambda c: F.struct("repo", F.col(c).alias("path"))
    edges = resolved_siblings(spark, folder).select(place("src").alias("src"), place("dst").alias("dst"))
    first = files(spark, folder).where("repo IS NOT NULL AND path IS NOT NULL").groupBy("repo").agg(F.min("path").alias("path"))
    return reach.reachable(edges, first.select(F.struct("repo", "path").alias("id"))).select("id.repo", "id.path")


_EXPORTS = "ex AS (SELECT DISTINCT path, name FROM u WHERE name IS NOT NULL), ed AS (SELECT DISTINCT ua.path AS src, ub.path AS dst, CASE WHEN e.similarity >= 0.97 THEN '*' ELSE ub.name END AS name FROM edges e JOIN u ua ON ua.unit_id = e.a JOIN u ub ON ub.unit_id = e.b WHERE e.similarity >= 0.85 AND e.similarity <= 1 AND ub.name IS NOT NULL), live AS (SELECT DISTINCT path AS id FROM u WHERE size >= 60)"


def _exports(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = units(spark, folder)
    exports = own.where("name IS NOT NULL").select("path", "name").distinct()
    edges = table(spark, folder, "edges").where("similarity >= 0.85 AND similarity <= 1")
    a, b = own.select(F.col("unit_id").alias("a"), F.col("path").alias("src")), own.where("name IS NOT NULL").select(F.col("unit_id").alias("b"), F.col("path").alias("dst"), "name")
    named = edges.join(a, "a").join(b, "b").select("src", "dst", F.array(F.when(F.col("similarity") >= 0.97, "*").otherwise(F.col("name"))).alias("names"))
    return named, exports, own.where("size >= 60").select(F.col("path").alias("id")).distinct()


_USED = "used AS (SELECT dst AS path, name FROM ed WHERE name <> '*' AND src IN (SELECT id FROM live) UNION SELECT ex.path, ex.name FROM ex WHERE path IN (SELECT dst FROM ed WHERE name = '*' AND src IN (SELECT id FROM live)))"


@query(f"WITH {_UNITS}, {_EXPORTS}, {_USED} SELECT path, name FROM used")
def used_exports(spark, folder):
    """Units as exports, edges as imports; an edge of 0.97 or more takes the whole file."""
    return reach.used_exports(*_exports(spark, folder))


@query(f"WITH {_UNITS}, {_EXPORTS}, {_USED} SELECT path, name FROM ex WHERE path IN (SELECT id FROM live) AND (path, name) NOT IN (SELECT path, name FROM used)")
def dead_exports(spark, folder):
    edges, exports, live = _exports(spark, folder)
    spare = spark.createDataFrame([], "path string, name string, n int")
    nobody = spark.createDataFrame([], "id string")
    found = reach.dead_exports(exports.withColumn("line", F.lit(1)), reach.used_exports(edges, exports, live), live, nobody, spare)
    return found.select("path", "name")


@query(
    f"""WITH {_UNITS}, {_FILES}, needle AS (SELECT DISTINCT name AS needle FROM u WHERE length(name) >= 4 AND name NOT IN ({', '.join(repr(g) for g in scalar.GENERIC_NAMES)})),
txt AS (SELECT file_id, text FROM f WHERE path LIKE '%.json' AND length(text) >= 4) SELECT needle, min_by(CAST(file_id AS VARCHAR), file_id) AS path FROM needle JOIN txt ON contains(txt.text, needle) GROUP BY needle"""
)
def mentions(spark, folder):
    """Names of units that data files mention, with the first file that does."""
    names = units(spark, folder).where("name IS NOT NULL").select(F.col("name").alias("id"), F.col("name").alias("needle"), F.lit("").alias("exclude")).distinct()
    data = files(spark, folder).where("path LIKE '%.json'").select(F.col("file_id").cast("string").alias("path"), F.col("file_id").alias("ord"), "text")
    return reach.mentions(names, data).select("needle", "path")


# -- reports -------------------------------------------------------------------------------------------------------


@query(f"WITH {_UNITS} SELECT unit_id FROM u ORDER BY md5('1|' || unit_id), unit_id LIMIT 200")
def seeded_sample(spark, folder):
    return calibrate.draw(units(spark, folder).select("unit_id"), 1, 200, "unit_id")


@query("SELECT coalesce(detector, 'none') AS detector, count(*) AS logged, count(DISTINCT path) AS paths FROM failures GROUP BY ROLLUP (detector) HAVING grouping(detector) = 0 UNION ALL SELECT 'overall', count(*), count(DISTINCT path) FROM failures")
def failure_totals(spark, folder):
    rows = table(spark, folder, "failures").rollup("detector").agg(F.count("*").alias("logged"), F.count_distinct("path").alias("paths"), F.grouping("detector").alias("g"))
    return rows.select(F.when(F.col("g") == 1, "overall").otherwise(F.coalesce("detector", F.lit("none"))).alias("detector"), "logged", "paths")


@query(f"WITH {_UNITS} SELECT unit_id FROM u WHERE end_line - start_line + 1 >= 5 AND size >= 40 AND size <= 5000")
def calibration_candidates(spark, folder):
    return units(spark, folder).where("end_line - start_line + 1 >= 5 AND size >= 40 AND size <= 5000").select("unit_id")


@query(f"WITH {_RULES} SELECT rule_id, list_sort(list_distinct(list_filter(list_transform(string_split(raw, ';'), lambda d: lower(trim(regexp_replace(d, '\\s+', ' ', 'g')))), lambda d: d <> ''))) AS declarations FROM r WHERE raw IS NOT NULL AND NOT regexp_matches(raw, '[\"'']|(?i:url\\()')")
def declaration_sets(spark, folder):
    """A rule's declarations from its raw key, normalised, distinct and sorted."""
    plain = rules(spark, folder).where("raw IS NOT NULL").where(~F.col("raw").rlike("[\"']|(?i:url\\()"))
    parts = F.transform(F.split("raw", ";"), lambda d: scalar.normalize_value(d))
    return plain.select("rule_id", F.array_sort(F.array_distinct(F.filter(parts, lambda d: d != ""))).alias("declarations"))


# -- scalar rules and rollups over the tables -----------------------------------------------------------------------


@query(f"WITH {_RULES}, d AS (SELECT rule_id, trim(list_extract(string_split(d, ':'), 1)) AS p FROM (SELECT rule_id, unnest(string_split(raw, ';')) AS d FROM r WHERE raw IS NOT NULL)) SELECT DISTINCT rule_id, CASE WHEN starts_with(p, '--') THEN p ELSE lower(p) END AS property FROM d WHERE p <> ''")
def property_names(spark, folder):
    parts = rules(spark, folder).where("raw IS NOT NULL").select("rule_id", F.explode(F.split("raw", ";")).alias("d"))
    return parts.select("rule_id", scalar.normalize_property(F.element_at(F.split("d", ":"), 1)).alias("property")).where("property <> ''").distinct()


@query("SELECT failure_id, list_filter(regexp_split_to_array(message, '[\\s&|;<>()\"''`=]+'), lambda w: w <> '') AS words FROM failures WHERE message IS NOT NULL")
def command_words(spark, folder):
    """The word rule of shell commands, over the log's messages."""
    return table(spark, folder, "failures").where("message IS NOT NULL").select("failure_id", scalar.script_words(F.col("message")).alias("words"))


@query("SELECT clone_id, array_to_string(list_filter(string_split('kept/' || source_id_a, '/'), lambda p: p <> '' AND p <> '.'), '/') AS path FROM token_clones WHERE source_id_a IS NOT NULL")
def resolved_places(spark, folder):
    """Source ids as paths of one folder; none of them climbs out of it."""
    clones = table(spark, folder, "token_clones").where("source_id_a IS NOT NULL")
    return clones.select("clone_id", scalar.resolve_path(F.lit("kept"), F.col("source_id_a")).alias("path"))


@query(f"WITH {_FILES}, e AS (SELECT lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, sum({_LINES}) AS n FROM f WHERE text IS NOT NULL GROUP BY 1) SELECT ext, printf('%.1f%%', n * 100.0 / (SELECT sum(n) FROM e)) AS share FROM e")
def extension_shares(spark, folder):
    counted = files(spark, folder).where("text IS NOT NULL").groupBy(scalar.extension(F.col("path")).alias("ext")).agg(F.sum(scalar.count_lines(F.col("text"))).alias("n"))
    return counted.select("ext", scalar.percent(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("share"))  # one row an extension


@query(f"WITH {_UNITS} SELECT unit_id, CAST(len(list_distinct(list_transform(range(1, len(features) - 3), lambda i: list_slice(features, i, i + 4)))) AS INTEGER) AS runs FROM u WHERE features IS NOT NULL")
def feature_runs(spark, folder):
    """How many different runs of five a unit's sorted features hold."""
    return units(spark, folder).where("features IS NOT NULL").select("unit_id", F.size(F.array_distinct(scalar.shingles(F.col("features")))).alias("runs"))


@query(f"WITH {_RULES} SELECT rule_id FROM r WHERE regexp_matches(raw, '[*?\\[\\]{{}}()!]')")
def pattern_like_keys(spark, folder):
    return rules(spark, folder).where(scalar.glob_unsafe(F.col("raw"))).select("rule_id")


@query(f"WITH {_FILES} SELECT file_id FROM f WHERE regexp_matches(path, '^([^/]+/)*(ui|server)/[^/]+/[a-m][^/]*\\.(ts|css)$') OR regexp_matches(path, '^packages/[^/]+/app/')")
def ignored_by_patterns(spark, folder):
    return files(spark, folder).where(F.col("path").rlike(globs_to_regex(("**/{ui,server}/*/[a-m]*.{ts,css}", "packages/*/app/**")))).select("file_id")


_DAYS = "SELECT date_trunc('day', seen_at) AS start, date_trunc('day', seen_at) + INTERVAL 1 DAY AS \"end\", repo, count(*) AS deliveries FROM css_rules WHERE seen_at IS NOT NULL GROUP BY ALL"


@query(_DAYS)
def deliveries_a_day(spark, folder):
    """The windowed counts of the stream over the whole table at once: no row is late then."""
    return incremental.windowed_deliveries(table(spark, folder, "css_rules"), "seen_at")


_MARKED = f"{_MEMBERS}, n AS (SELECT cluster_id AS path, CASE lower(kind) WHEN 'identical' THEN 'copy' WHEN 'normalized' THEN 'rename' ELSE 'literals' END AS kind FROM clone_clusters), hit AS (SELECT DISTINCT cluster AS path FROM m WHERE end_line - start_line >= 20)"


@query(
    f"""WITH {_MARKED}, c AS (SELECT n.kind, hit.path IS NOT NULL AS hit FROM n LEFT JOIN hit USING (path)),
k AS (SELECT unnest({list(calibrate.MUTATIONS)}) AS kind), r AS (SELECT k.kind, count(c.kind) AS attempted, count(c.kind) FILTER (WHERE hit) AS detected FROM k LEFT JOIN c USING (kind) GROUP BY 1
UNION ALL SELECT 'overall', count(*), count(*) FILTER (WHERE hit) FROM c)
SELECT kind, attempted, detected, CASE WHEN attempted = 0 THEN 0.0 ELSE CAST(detected AS DOUBLE) / attempted END AS recall FROM r"""
)
def recall_by_kind(spark, folder):
    """The recall table, with logged groups in the place of mutants: those with a member of more than 20 lines count as found."""
    kind = F.when(F.lower("kind") == "identical", "copy").when(F.lower("kind") == "normalized", "rename").otherwise("literals")
    marked = table(spark, folder, "clone_clusters").select(F.col("cluster_id").alias("path"), kind.alias("kind"))
    return calibrate.recall(marked, _members(spark, folder).where("end_line - start_line >= 20").select(F.col("cluster").alias("path")).distinct())


@query(
    f"""WITH {_UNITS}, {_EXPORTS}, {_USED}, own AS (SELECT path, name, count(*) AS n FROM u WHERE name IS NOT NULL GROUP BY 1, 2), ent AS (SELECT DISTINCT path FROM u WHERE size >= 250)
SELECT path, name FROM ex LEFT JOIN own USING (path, name) WHERE path IN (SELECT id FROM live) AND path NOT IN (SELECT path FROM ent) AND (path, name) NOT IN (SELECT path, name FROM used) AND (name = 'default' OR coalesce(n, 0) <= 1)"""
)
def dead_exports_but_entries(spark, folder):
    """Files with a very large unit are entries; a name that its file has more than once is used there."""
    edges, exports, live = _exports(spark, folder)
    named = units(spark, folder).where("name IS NOT NULL")
    entries = units(spark, folder).where("size >= 250").select(F.col("path").alias("id")).distinct()
    found = reach.dead_exports(exports.withColumn("line", F.lit(1)), reach.used_exports(edges, exports, live), live, entries, named.groupBy("path", "name").agg(F.count("*").alias("n")))
    return found.select("path", "name")


# -- readers, without SQL ------------------------------------------------------------------------------------------


def _inventory(spark: SparkSession, folder: str) -> DataFrame:
    own = files(spark, folder).where("text IS NOT NULL")
    return own.select("ord", F.concat("repo", F.lit("/"), "path").alias("path"), scalar.extension(F.col("path")).alias("ext"), "text", scalar.count_lines(F.col("text")).alias("lines"), F.coalesce("excluded", F.lit(False)).alias("excluded"))


@query()
def read_units(spark, folder):
    """Function units of every script, with their keys and sizes."""
    s = Structure()
    return script.script_units(_inventory(spark, folder), s.minLines, s.minNodes).where("error IS NULL").select("path", "name", "start_line", "end_line", "size", "normalized", "raw")


@query()
def near_miss_units(spark, folder):
    """Clusters of functions, edited copies confirmed by tree edit distance."""
    s = Structure()
    from twinsift.session import Scratch

    found = Scratch(spark, "near-miss").cut(script.script_units(_inventory(spark, folder), s.minLines, s.minNodes).where("error IS NULL"), "units")
    clusters, _ = similarity.cluster_units(found.drop("error", "path", "name", "start_line", "end_line"), s.similarity, s.candidateJaccard, s.maxPosting, confirm_trees(s.similarity), sized=True)
    return clusters


@query()
def read_rules(spark, folder):
    return css.style_rules(_inventory(spark, folder), 3).where("error IS NULL").select("path", "name", "start_line", "end_line", "normalized")


@query()
def references(spark, folder):
    """Imports, exports, computed references, literals and identifiers of every script, counted by kind."""
    return script.script_references(_inventory(spark, folder)).groupBy("path", "relation").agg(F.count("*").alias("n"))


@query()
def token_runs(spark, folder):
    return tokens.match_tokens(_inventory(spark, folder).where("ext <> '.json'"))

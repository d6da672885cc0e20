"""The queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import components, handwritten, leakage, neardup, sentences, setjoin, spans, syntax, templates, tokenizer
from twinsift.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = setjoin.rule_pairs(table(spark, folder, "css_rules"), table(spark, folder, "library_rules"))
    return pairs.select("rule_a", "rule_b")


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.rule_pairs(table(spark, folder, "css_rules"), table(spark, folder, "library_rules"))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.rule_classes(table(spark, folder, "css_rules"), table(spark, folder, "library_rules"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.failures(table(spark, folder, "source_files")).select("file_id")


def p2_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Failure rows: the path as repository and path, and the message of the first error."""
    return syntax.failures(table(spark, folder, "source_files")).select(F.concat_ws("/", "repo", "path").alias("path"), "message")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.failure_rates(table(spark, folder, "source_files"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.unit_groups(table(spark, folder, "edges"))


def p3_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return components.group_sizes(components.unit_groups(table(spark, folder, "edges")))


def p4_method(spark: SparkSession, folder: str) -> DataFrame:
    """The identifier models alone, over the whole table."""
    return handwritten.named_verdicts(table(spark, folder, "source_files"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.classify(table(spark, folder, "source_files")).select("file_id")


def p4_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.classify(table(spark, folder, "source_files"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.found_pairs(table(spark, folder, "source_files"), table(spark, folder, "units")).select("rec", "a", "b")


def p5_file_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Files by runs of five words at 0.8: one row for each file."""
    return neardup.classes(*neardup.near_files(table(spark, folder, "source_files")))


def p5_unit_classes(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(*neardup.near_units(table(spark, folder, "units")))


def p6_method(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of each file that another file has, exactly or nearly: compact windows of several min-hashes."""
    return spans.near_passages(table(spark, folder, "source_files"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.file_pairs(table(spark, folder, "source_files"))


def p6_fragments(spark: SparkSession, folder: str) -> DataFrame:
    return spans.fragments(table(spark, folder, "source_files")).select("source_id", "file_id", "start", "end", "start_line", "end_line")


def p6_shared(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_part(table(spark, folder, "source_files"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, folder, "documents"))


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    counted = tokenizer.encode_corpus(documents).select("doc_id", F.size("ids").alias("tokens"))
    return counted.join(documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


def p8_method(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold an item's template, also with other numbers, names and units in its slots."""
    return templates.template_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.items_leaked(p8_found(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.split_sentences(table(spark, folder, "documents")).select("doc_id", "sent_end")


def p9_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence with its text."""
    documents = table(spark, folder, "documents")
    cut = sentences.split_sentences(documents)
    body = F.substring("text", F.col("sent_start") + 1, F.col("sent_end") - F.col("sent_start"))
    return cut.join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "sent_no", body.alias("sentence"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


_P1 = """
WITH r AS (
  SELECT rule_id, any_value(list_distinct(list_filter(features, lambda x: x IS NOT NULL))) AS s
  FROM (SELECT rule_id, features FROM css_rules UNION ALL SELECT rule_id, features FROM library_rules)
  WHERE rule_id IS NOT NULL AND features IS NOT NULL GROUP BY rule_id
), e AS (SELECT rule_id, len(s) AS n, unnest(s) AS f FROM r WHERE len(s) >= 3),
pair AS (
  SELECT x.rule_id AS rule_a, y.rule_id AS rule_b, count(*) AS o, any_value(x.n + y.n) AS n
  FROM e x JOIN e y ON x.f = y.f AND x.rule_id < y.rule_id AND x.n * 100 >= 85 * y.n AND y.n * 100 >= 85 * x.n GROUP BY 1, 2
)
"""
_P3 = """
WITH RECURSIVE l AS (
  SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM edges
  WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b AND similarity IS NOT NULL AND NOT isnan(similarity) AND similarity BETWEEN 0.85 AND 1
), s AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
lower(unit_id, least_id) AS (
  SELECT a, a FROM s UNION SELECT s.b, r.least_id FROM lower r JOIN s ON r.unit_id = s.a WHERE r.least_id < s.b
), g AS (SELECT unit_id, min(least_id) AS group_id FROM lower GROUP BY unit_id)
"""
_WORDS = """
w AS (SELECT file_id AS id, regexp_extract_all(lower(any_value(text)), '[a-z0-9_]+') AS w FROM source_files WHERE file_id IS NOT NULL AND text IS NOT NULL GROUP BY file_id),
shingle AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - {last} + 1), lambda i: {run})) AS f FROM w WHERE len(w) > {last}),
size AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
met AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM shingle x JOIN shingle y ON x.f = y.f AND x.id < y.id GROUP BY 1, 2)
"""
_UNITS = """
u AS (SELECT unit_id AS id, any_value(list_distinct(list_filter(features, lambda x: x IS NOT NULL))) AS s FROM units WHERE unit_id IS NOT NULL AND features IS NOT NULL GROUP BY unit_id),
e AS (SELECT id, len(s) AS n, unnest(s) AS f FROM u),
unit_met AS (SELECT x.id AS a, y.id AS b, count(*) AS o, any_value(x.n + y.n) AS n FROM e x JOIN e y ON x.f = y.f AND x.id < y.id AND x.n * 5 >= y.n * 4 AND y.n * 5 >= x.n * 4 GROUP BY 1, 2)
"""

#: Classes of equal sets, pairs of classes that reach the threshold, and how many a class has; ``sets`` holds ``id, s``, sorted.
_CLASSES = """
rep AS (SELECT s, min(id) AS class_id FROM sets GROUP BY s),
ce AS (SELECT class_id, len(s) AS n, unnest(s) AS f FROM rep),
cm AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS o, any_value(x.n + y.n) AS n FROM ce x JOIN ce y ON x.f = y.f AND x.class_id < y.class_id AND x.n * 100 >= {t} * y.n AND y.n * 100 >= {t} * x.n GROUP BY 1, 2),
link AS (SELECT a, b FROM cm WHERE o * 100 >= {t} * (n - o)),
degree AS (SELECT id AS class_id, count(*) AS links FROM (SELECT a AS id FROM link UNION ALL SELECT b FROM link) GROUP BY 1)
SELECT id AS {key}, class_id, coalesce(links, 0) AS links FROM sets JOIN rep USING (s) LEFT JOIN degree USING (class_id)
"""
#: Stretches of each file whose runs of 300 characters another file has too; equal texts included.
_STRETCHES = """
WITH t AS (SELECT file_id, max(repo) AS repo, max(path) AS path, max(text) AS text FROM source_files WHERE file_id IS NOT NULL AND length(text) >= 300 GROUP BY file_id),
g AS (SELECT file_id, p, substr(text, p, 300) AS run FROM (SELECT file_id, text, unnest(range(1, length(text) - 298)) AS p FROM t)),
two AS (SELECT run FROM g GROUP BY run HAVING min(file_id) <> max(file_id)),
sh AS (SELECT file_id, p FROM g JOIN two USING (run)),
o AS (SELECT file_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY file_id ORDER BY p) <= 300 THEN 0 ELSE 1 END AS fresh FROM sh),
i AS (SELECT file_id, p, sum(fresh) OVER (PARTITION BY file_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM o),
st AS (SELECT file_id, min(p) - 1 AS s, max(p) + 299 AS e FROM i GROUP BY file_id, island)
"""


def oracle_sql() -> dict[str, str]:
    words = _WORDS.format(last=2, run="w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]")
    words5 = _WORDS.format(last=4, run=" || ' ' || ".join(f"w[i + {k}]" for k in range(5))).replace("w[i + 0]", "w[i]").split("met AS")[0].rstrip().rstrip(",")
    return {
        "p1_found": _P1 + "SELECT rule_a, rule_b FROM pair WHERE o * 100 >= 85 * (n - o)",
        "p1_pairs": _P1 + "SELECT rule_a, rule_b, o / (n - o) AS jaccard FROM pair WHERE o * 100 >= 85 * (n - o)",
        "p1_classes": "WITH sets AS (SELECT rule_id AS id, list_sort(any_value(list_distinct(list_filter(features, lambda x: x IS NOT NULL)))) AS s FROM (SELECT rule_id, features FROM css_rules UNION ALL SELECT rule_id, features FROM library_rules) WHERE rule_id IS NOT NULL AND features IS NOT NULL GROUP BY rule_id HAVING len(s) >= 3)," + _CLASSES.format(t=85, key="rule_id"),
        "p3_found": _P3 + "SELECT group_id, unit_id FROM g",
        "p3_sizes": _P3 + "SELECT group_id, count(*) AS members FROM g GROUP BY group_id",
        "p5_found": f"""
WITH {words}, {_UNITS}
SELECT 'file' AS rec, a, b FROM met JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE o * 10 >= 7 * (x.n + y.n - o)
UNION ALL SELECT 'unit', a, b FROM unit_met WHERE o * 10 >= 8 * (n - o)""",
        "p5_file_classes": f"WITH {words5}, sets AS (SELECT id, list_sort(list(f)) AS s FROM shingle GROUP BY id)," + _CLASSES.format(t=80, key="id"),
        "p5_unit_classes": f"WITH {_UNITS}, sets AS (SELECT id, list_sort(s) AS s FROM u WHERE len(s) > 0)," + _CLASSES.format(t=80, key="id"),
        "p6_fragments": _STRETCHES + """
SELECT repo || '/' || path AS source_id, file_id, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end",
  CAST(len(regexp_extract_all(substr(text, 1, s), '\\r\\n|\\r|\\n')) + 1 AS INTEGER) AS start_line, CAST(len(regexp_extract_all(substr(text, 1, e - 1), '\\r\\n|\\r|\\n')) + 1 AS INTEGER) AS end_line
FROM st JOIN t USING (file_id)""",
        "p6_shared": _STRETCHES + "SELECT file_id, CAST(sum(e - s) AS BIGINT) AS shared_chars, CAST(any_value(length(text)) AS BIGINT) AS n_chars, CAST(sum(e - s) AS BIGINT) / any_value(length(text)) AS share FROM st JOIN t USING (file_id) GROUP BY file_id",
        "p6_found": """
WITH t AS (SELECT file_id, any_value(text) AS text FROM source_files WHERE file_id IS NOT NULL AND length(text) >= 300 GROUP BY file_id),
g AS (SELECT DISTINCT file_id, substr(text, p, 300) AS run FROM (SELECT file_id, text, unnest(range(1, length(text) - 298)) AS p FROM t))
SELECT DISTINCT x.file_id AS file_a, y.file_id AS file_b FROM g x JOIN g y ON x.run = y.run AND x.file_id < y.file_id""",
    }

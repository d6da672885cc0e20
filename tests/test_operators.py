"""Operators on small fixtures, against brute force and worked numbers."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.conftest import ORDER_TOTAL, inventory
from twinsift.config import Config, ConfigError, load_config, merge, validate
from twinsift.functions import globs, scalar
from twinsift.operators import baseline, calibrate, lines, reach, similarity, ted, tokens
from twinsift.operators.entrypoints import resolve_entries, source_candidates
from twinsift.operators.resolve import CompilerOptions, resolve_specifiers
from twinsift.sources import css, script
from twinsift.sources.project import InventoryError, compiler_options, list_paths, parse_jsonc, parse_manifest, read_inventory


def tree(shape) -> ted.Tree:
    """``("a", child, ...)`` in post-order arrays."""
    labels, left = [], []

    def walk(node):
        begin = len(labels)
        for child in node[1:]:
            walk(child)
        left.append(begin)
        labels.append(ord(node[0]))

    walk(shape)
    return labels, left


def brute(a, b):
    """Distance of two forests by the definition."""
    if not a and not b:
        return 0
    size = lambda f: sum(1 + size(t[1:]) for t in f)
    if not a:
        return size(b)
    if not b:
        return size(a)
    x, y = a[-1], b[-1]
    return min(brute(a[:-1] + x[1:], b) + 1, brute(a, b[:-1] + y[1:]) + 1, brute(a[:-1], b[:-1]) + brute(x[1:], y[1:]) + (x[0] != y[0]))


def grown(draw, budget):
    node, left = [draw.choice("abc")], budget - 1
    while left > 0 and draw.random() < 0.55:
        take = draw.randint(1, left)
        child = grown(draw, take)
        node.append(child)
        left -= take
    return tuple(node)


def test_classic_trees():
    a = tree(("f", ("d", ("a",), ("c", ("b",))), ("e",)))
    b = tree(("f", ("c", ("d", ("a",), ("b",))), ("e",)))
    assert ted.edit_distance(a, b) == 2


def test_distance_equals_brute_force_and_its_bound():
    draw = random.Random(42)
    for _ in range(150):
        x, y = grown(draw, 7), grown(draw, 7)
        want = brute((x,), (y,))
        a, b = tree(x), tree(y)
        assert ted.edit_distance(a, b) == want == ted.edit_distance(b, a)
        assert ted.edit_distance(ted.mirrored(a), ted.mirrored(b)) == want
        bound = draw.randrange(8)
        assert ted.edit_distance(a, b, bound) == min(want, bound + 1)


def test_large_trees_and_mirror():
    draw = random.Random(23)
    a = tree(("r", *[grown(draw, 40) for _ in range(10)]))
    assert ted.mirrored(ted.mirrored(a)) == a
    changed = list(a[0])
    for i in range(0, len(changed), max(1, len(changed) // 5)):
        changed[i] += 50
    count = sum(x != y for x, y in zip(a[0], changed))
    assert ted.edit_distance(a, (changed, a[1]), 20) == count
    assert ted.edit_distance(([], []), a) == len(a[0])


def items(spark, sets):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id bigint, features array<int>")


@pytest.mark.parametrize("cut", [64, None])
def test_candidate_pairs(spark, cut):
    rows = similarity.candidate_pairs(items(spark, [[1, 2, 3, 4], [1, 2, 3, 5, 5, None], [9, 10, 11, 12], [], None]), 0.5, cut).collect()
    assert [tuple(r) for r in rows] == [(0, 1, 3, 3 / 5)]


def test_posting_cut(spark):
    sets = items(spark, [[100, 1], [100, 2], [100, 3]])
    assert similarity.candidate_pairs(sets, 0.1, 2).count() == 0
    assert similarity.candidate_pairs(sets, 0.1, 3).count() == 3


def test_whole_candidate_pairs_keep_what_many_hold(spark, tmp_path):
    from twinsift.plans.queries import QUERIES

    rows = [(i, [1, 2, 3, 4], 10) for i in range(70)] + [(100, [1, 2, 3, 5], 10), (101, [1, 2, 3, 4], 5), (102, None, 5), (103, [9], None)]
    made = spark.createDataFrame(rows, "unit_id bigint, features array<int>, size int")
    texts = [F.lit("x").alias(c) for c in ("file_id", "repo", "path", "name", "normalized", "raw")]
    made.select("*", *texts, F.lit(1).alias("start_line"), F.lit(2).alias("end_line")).write.parquet(str(tmp_path / "units.parquet"))
    got = {(r["a"], r["b"], r["overlap"]) for r in QUERIES["whole_candidate_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(0, 100, 3), (0, 101, 4), (100, 101, 3)}
    assert [tuple(r) for r in QUERIES["whole_comparable_pairs"](spark, str(tmp_path)).collect()] == [(0, 100, 1.0)]
    heads = {r["unit_id"]: r["head"] for r in QUERIES["candidate_groups"](spark, str(tmp_path)).collect()}
    assert heads == {**{i: 0 for i in range(70)}, 100: 100, 101: 101, 103: 103}


def test_uncut_pairs_match_brute_force(spark):
    draw = random.Random(9)
    sets = [sorted(draw.sample(range(14), draw.randint(1, 9))) for _ in range(80)]
    got = {(r["a"], r["b"]) for r in similarity.candidate_pairs(items(spark, sets), 0.7).collect()}
    want = {(a, b) for a, b in combinations(range(80), 2) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.7}
    assert got == want and want


def test_weakest_link_of_a_cluster(spark):
    units = spark.createDataFrame([(0, "A", "a", [1, 2]), (1, "A", "a2", [1, 2]), (2, "B", "b", [1, 2]), (3, "C", "c", [1, 2]), (4, "D", "d", [7])], "ord bigint, normalized string, raw string, features array<int>")
    links = {(0, 2): 0.95, (2, 3): 0.9, (0, 3): 0.2}

    def confirm(pairs):
        scored = spark.createDataFrame([(a, b, s) for (a, b), s in links.items()], "a bigint, b bigint, similarity double")
        return pairs.select("a", "b").join(scored, ["a", "b"])

    clusters, members = similarity.cluster_units(units, 0.85, 0.4, 64, confirm)
    assert [tuple(r) for r in clusters.collect()] == [(0, "near-miss", 0.9, 4)]
    assert sorted(r["ord"] for r in members.collect()) == [0, 1, 2, 3]


def test_components(spark):
    pairs = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (None, 3)]
    got = {r["id"]: r["component"] for r in similarity.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert similarity.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


MEMBERS = "cluster string, member int, path string, start_line int, end_line int, name string"


def members(spark, rows):
    return spark.createDataFrame([(c, i, p, a, b, None) for i, (c, p, a, b) in enumerate(rows)], MEMBERS)


def test_duplicated_lines(spark):
    three = members(spark, [("c", "a", 1, 10), ("c", "b", 1, 10), ("c", "d", 1, 10)])
    assert lines.duplicated_lines(three).first()[0] == 20
    overlapping = members(spark, [("1", "a", 1, 10), ("1", "z", 1, 10), ("2", "a", 1, 5), ("2", "z", 4, 12)])
    assert lines.duplicated_lines(overlapping).first()[0] == 12
    assert lines.duplicated_lines(members(spark, [])).first()[0] == 0


def test_adjacent_spans_merge(spark):
    spans = spark.createDataFrame([("a", 1, 3), ("a", 4, 6), ("a", 8, 9), ("b", 2, 1), ("a", None, 4)], "path string, start_line int, end_line int")
    assert sorted(tuple(r) for r in lines.span_islands(spans, "path").collect()) == [("a", 1, 6), ("a", 8, 9)]


def test_explained_pairs(spark):
    pairs = spark.createDataFrame([(1, "a", 2, 5, "b", 2, 5), (2, "a", 2, 5, "a", 6, 9), (3, "a", 2, 50, "b", 2, 5)], "pair bigint, path_a string, start_a int, end_a int, path_b string, start_b int, end_b int")
    cluster = members(spark, [("c", "a", 1, 10), ("c", "b", 1, 10)])
    assert sorted(r["pair"] for r in lines.unexplained_pairs(pairs, cluster).collect()) == [2, 3]


def test_coverage(spark):
    files = spark.createDataFrame([("a.ts", ".ts", 2), ("b.vue", ".vue", 4)], "path string, ext string, lines int")
    seen = spark.createDataFrame([("a.ts",), ("a.ts",)], "path string")
    row = lines.coverage(files, seen).first()
    assert (row["covered_lines"], row["total_lines"], row["percent"]) == (2, 6, 200 / 6)
    assert [tuple(r) for r in lines.uncovered_by_extension(files, seen).collect()] == [(".vue", 4)]
    assert lines.coverage(files.limit(0), seen).first()["percent"] == 100.0


def prints(spark, text, rows, kind="identical"):
    clusters = spark.createDataFrame([("c", "css", kind)], "cluster string, detector string, kind string")
    return baseline.cluster_fingerprints(clusters, members(spark, rows), spark.createDataFrame(text, "path string, text string")).first()["fingerprint"]


def test_fingerprints_follow_content_not_lines(spark):
    base = prints(spark, [("a", "x\ny\nz\n"), ("b", "y\nz\n")], [("c", "a", 2, 3), ("c", "b", 1, 2)])
    assert prints(spark, [("a", "0\r\nx\r\ny\r\nz\r\n"), ("b", "y\nz\n")], [("c", "b", 1, 2), ("c", "a", 3, 4)]) == base
    assert prints(spark, [("a", "x\nY\nz\n"), ("b", "y\nz\n")], [("c", "a", 2, 3), ("c", "b", 1, 2)]) != base
    assert prints(spark, [("a", "x\ny\nz\n"), ("b", "y\nz\n")], [("c", "a", 2, 3), ("c", "b", 1, 2)], "normalized") != base
    assert prints(spark, [("b", "y\nz\n")], [("c", "a", 2, 3), ("c", "b", 1, 2)]) != base


def test_reachability_and_uses(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("b", "b")], "src string, dst string")
    start = spark.createDataFrame([("a",), ("gone",)], "id string")
    nodes = spark.createDataFrame([(x,) for x in "abcxy"], "id string")
    live = reach.reachable(edges, start, nodes)
    assert sorted(r["id"] for r in live.collect()) == ["a", "b", "c"]
    assert sorted(r["id"] for r in reach.dead_nodes(nodes, live).collect()) == ["x", "y"]
    named = spark.createDataFrame([("a", "b", ["f"]), ("a", "c", ["*"]), ("x", "b", ["g"])], "src string, dst string, names array<string>")
    exports = spark.createDataFrame([("b", "f", 1), ("b", "g", 2), ("c", "h", 3), ("c", "default", 4)], "path string, name string, line int")
    used = reach.used_exports(named, exports, live)
    assert sorted(tuple(r) for r in used.collect()) == [("b", "f"), ("c", "default"), ("c", "h")]
    own = spark.createDataFrame([("b", "g", 1)], "path string, name string, n int")
    assert [tuple(r) for r in reach.dead_exports(exports, used, live, start.where("id = 'a'"), own).collect()] == [("b", "g", 2)]


def test_mentions(spark):
    needles = spark.createDataFrame([(1, "panelMenu", "own"), (2, "abc", ""), (3, "index", ""), (4, "own/path", "")], "id int, needle string, exclude string")
    texts = spark.createDataFrame([("own", 1, "panelMenu"), ("z", 2, "the panelMenuBar"), ("y", 1, "has panelMenu"), ("q", 1, "abc index"), ("r", 5, "an own/path here")], "path string, ord int, text string")
    assert sorted(tuple(r) for r in reach.mentions(needles, texts).collect()) == [(1, "panelMenu", "y"), (4, "own/path", "r")]


def test_specifiers(spark):
    edges = spark.createDataFrame([("src/a.ts", s) for s in ["./b", "./c.js", "../lib", "@app/d", "react", "../../out", "./a", "./style.css", "deep/e", "./f?raw"]], "src string, specifier string")
    known = spark.createDataFrame([(p,) for p in ["src/a.ts", "src/b.tsx", "src/c.ts", "lib/index.ts", "src/app/d.ts", "src/style.css", "src/deep/e.ts", "src/f.ts", "out.ts"]], "path string")
    options = CompilerOptions(base_url="src", paths={"@app/*": ("app/*",)})
    got = {r["specifier"]: r["dst"] for r in resolve_specifiers(edges, known, options).collect()}
    assert got == {"./b": "src/b.tsx", "./c.js": "src/c.ts", "../lib": "lib/index.ts", "@app/d": "src/app/d.ts", "./style.css": "src/style.css", "deep/e": "src/deep/e.ts", "./f?raw": "src/f.ts"}


def test_entries(spark):
    paths = ["src/index.ts", "main.js", "lib/index.ts", "src/tool.ts", "pages/home.tsx", "vite.config.ts", ".storybook/main.ts", "src/run.ts"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    manifest = parse_manifest('{"bin": {"x": "./dist/tool.js"}, "scripts": {"s": "node --loader=x src/run.ts && echo"}, "devDependencies": {"next": "1"}}')
    found = resolve_entries(files, manifest)
    assert sorted({r["path"] for r in found.program.collect()}) == ["main.js", "pages/home.tsx", "src/index.ts", "src/run.ts", "src/tool.ts"]
    assert sorted(r["path"] for r in found.tool_owned.collect()) == [".storybook/main.ts", "vite.config.ts"]
    assert "next conventions" in found.basis
    assert [r["path"] for r in resolve_entries(files, manifest, ("lib/**",)).program.collect()] == ["lib/index.ts"]
    assert "src/x.ts" in source_candidates("./dist/x.js", CompilerOptions()) and source_candidates("../x", CompilerOptions()) == []


def test_scalar_rules(spark):
    texts = ["", "a", "a\n", "a\nb\n", "a\n\nb", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(scalar.count_lines(F.col("t"))).collect()] == [0, 1, 1, 2, 3, None]
    row = spark.createDataFrame([("a/B.Ts", "  Red   1PX ", "url(A)", "--Ab", "src/x", "../../y", [1, 2, 3])], "p string, v string, u string, c string, d string, s string, l array<int>")
    got = row.select(
        scalar.extension(F.col("p")), scalar.normalize_value(F.col("v")), scalar.normalize_value(F.col("u")), scalar.normalize_property(F.col("c")), scalar.normalize_property(F.lit("Ab")),
        scalar.resolve_path(F.col("d"), F.col("s")), scalar.resolve_path(F.lit("a"), F.col("s")), F.size(scalar.shingles(F.col("l"), 5)), F.size(scalar.shingles(F.col("l"), 2)),
        scalar.script_words(F.lit("a --b=c && d|e")), scalar.percent(F.lit(12.345)), scalar.lines_between(F.lit("a\r\nb\nc"), F.lit(2), F.lit(3)), scalar.size_ratio(F.lit(3), F.lit(4)), scalar.glob_unsafe(F.lit("a[b]")),
    ).first()
    assert list(got) == [".ts", "red 1px", "url(A)", "--Ab", "ab", "y", None, 0, 2, ["a", "--b", "c", "d", "e"], "12.3%", "b\nc", 0.75, True]


@pytest.mark.parametrize(("pattern", "yes", "no"), [("**/*.min.*", ["a.min.js", "x/y/a.min.css"], ["a.js"]), ("src/*.ts", ["src/a.ts"], ["src/x/a.ts", "src/a.tsx"]), ("**/.*rc.{js,ts}", [".eslintrc.js", "a/.xrc.ts"], ["xrc.js"]), ("{src/,}app/**", ["app/x", "src/app/y/z"], ["lib/app/x"]), ("a?[bc].ts", ["axb.ts"], ["a/b.ts", "axd.ts"])])
def test_globs(pattern, yes, no):
    assert all(globs.matches(p, [pattern]) for p in yes) and not any(globs.matches(p, [pattern]) for p in no)
    assert not globs.matches("a", [])


def test_settings(tmp_path):
    assert load_config(str(tmp_path)) == validate(Config())
    with pytest.raises(ConfigError):
        load_config(str(tmp_path), "no.json")
    with pytest.raises(ConfigError) as e:
        merge(Config(), {"tokens": {"minLine": 3}, "__proto__": {}, "ignore": [1], "css": 3, "baseline": {"enabled": 1}})
    assert len(str(e.value).split("\n")) == 5
    got = merge(Config(), {"tokens": {"minLines": 9}, "detectors": ["css", "css"]})
    assert got.tokens.minLines == 9 and got.tokens.minTokens == 60 and validate(got).detectors == ("css",)
    with pytest.raises(ConfigError) as e:
        validate(merge(Config(), {"detectors": [], "gates": {"minCoveragePercent": 101}, "structure": {"similarity": 0}, "codeExtensions": ["ts"]}))
    assert len(str(e.value).split("\n")) == 4


def test_project_reading(spark, tmp_path):
    import subprocess

    with pytest.raises(InventoryError):
        list_paths("/proc")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for name, text in {"a.ts": "x\ny\n", "b.test.ts": "z\n", "c.md": "m\n", "ignored.ts": "i\n", ".gitignore": "ignored.ts\n", "tsconfig.json": '{ // c\n "extends": "./base.json", "compilerOptions": {"outDir": "./built",}, }', "base.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["*"]}}}'}.items():
        (tmp_path / name).write_text(text)
    rows = {r["path"]: (r["lines"], r["excluded"]) for r in read_inventory(spark, str(tmp_path), Config()).collect()}
    assert rows == {"a.ts": (2, False), "b.test.ts": (1, True)}
    options = compiler_options(str(tmp_path))
    assert (options.base_url, options.paths, options.out_dir) == ("src", {"@/*": ("*",)}, "built")
    assert parse_jsonc('{"a": "//x", /* c */ "b": [1,],}') == {"a": "//x", "b": [1]} and parse_jsonc("[") == {}
    assert parse_manifest("{") == parse_manifest(None) == parse_manifest("[]")


def test_script_extraction():
    text = """import d, { a as b } from 'm';\nimport * as ns from "n";\nimport 'side';\nexport * from 'all';\nexport * as sub from 'as';\nexport { x as y, z } from 'r';\nexport function f() {}\nexport default class {}\nexport const { p, q } = require('c');\nexport interface I {}\nconst l = import(`tpl`);\nrequire('./' + name);\nconst s = 'text';\n"""
    e = script.extract(text)
    assert ("m", "import", ["default", "a"]) in e.edges and ("n", "import", ["*"]) in e.edges and ("side", "import", []) in e.edges
    assert ("all", "re-export", ["*"]) in e.edges and ("as", "re-export", ["*"]) in e.edges and ("r", "re-export", ["x", "z"]) in e.edges
    assert ("c", "require", ["*"]) in e.edges and ("tpl", "dynamic-import", ["*"]) in e.edges
    assert [n for n, _ in e.exports] == ["sub", "y", "z", "f", "default", "p", "q", "I"]
    assert e.dynamic == ["'./' + name"] and "text" in e.literals and "m" not in e.literals and e.counts["name"] == 1
    with pytest.raises(script.ScriptError):
        script.extract("f(")


@pytest.mark.parametrize("text", ["const = 5;", "let x = ;", "if (a b) {}", "function f( {", "const a = <p>open;", "const t = `open ${a}", "/* open", "return 1 }", "x = 'open\n", "class A { m( { } }"])
def test_invalid_scripts_are_errors(text):
    with pytest.raises(script.ScriptError):
        script.lex(text)
    assert script.syntax_error(text)[0] == 1


MARKUP = """export function Card({ title, onPick }: Props) {
  const total = /[/'"]+/.test(title) ? `it's ${title}` : null;
  return (
    <section className="card" data-kind={total} {...rest}>
      It's ( one { of } the "cards"
      {items.map((item) => <Row.Cell key={item} onClick={() => onPick(item)}>don't</Row.Cell>)}
      <></>
    </section>
  );
}
""".replace("{ of }", "{of}")


def test_markup_is_read():
    tokens = script.lex(MARKUP)
    partner = script.match_brackets(tokens)
    assert [t.text for t in tokens if t.kind == "regex"] == ["/[/'\"]+/"]
    assert [t.text for t in tokens if t.kind == "markup"] == ["section", "className", "data-kind", "key", "onClick", "section"]
    assert [t.text for t in tokens if t.kind == "text"] == ["¶It's ( one", '¶the "cards"', "¶don't"]
    (unit,) = script.find_units(tokens, partner)
    assert (unit.name, unit.start_line, unit.end_line) == ("Card", 1, 10)
    counts = script.extract(MARKUP).counts
    assert counts["Row"] == 2 and counts["title"] == 3 and "section" not in counts and "className" not in counts
    (copy,) = script.read_units(MARKUP.replace("total", "sum").replace("item)", "one)").replace("{item}", "{one}"))
    assert copy.normalized == unit.normalized and copy.raw != unit.raw


def test_dialects_of_scripts():
    assert script.lex("type T = import('./d').T.U<string>[] | import('x');", "ts") and script.lex("let x = <number>y;", "ts") and script.lex("let x: number = 1;", script.dialect_of("a.js"))
    with pytest.raises(script.ScriptError):
        script.lex("const x = <p>1</p>;", script.dialect_of("a.ts"))
    deep = "type A = " + "(" * 3000 + "a" + ")" * 3000
    assert script.syntax_error(deep, "ts") is None and script.syntax_error(deep[:-1], "ts")


def test_style_reading(spark):
    (rule,) = css.read_rules("@media (x) {\n  .a {\n    --V: A;\n    Color: RED !important;\n    content: 'Q';\n  }\n}\n")
    assert (rule["name"], rule["start_line"], rule["end_line"]) == (".a", 2, 6)
    assert rule["normalized_key"] == "@media (x)|--V:a;color:red!important;content:'Q'"
    for bad in ("a {", "a }", "a { b: 'c }", "/* x"):
        with pytest.raises(css.StyleError):
            css.read_rules(bad)
    frame = spark.createDataFrame([("@import 'a.css'; /* @import 'no'; */ @import url(\"./b.css\");@import url(http://x/y.css);",)], "t string")
    assert frame.select(css.imported(F.col("t"))).first()[0] == ["./a.css", "./b.css", "http://x/y.css"]


def test_token_matcher_contract(spark):
    files = inventory(spark, {"a.js": "x", "b[1].js": "y"})
    with pytest.raises(tokens.MatcherError):
        tokens.token_clones(files, (".js",), 60, 5, lambda f, *_: f.select("path"))
    stray = lambda f, *_: spark.createDataFrame([("zz", 1, 2, "a.js", 1, 2)], "path_a string, start_a int, end_a int, path_b string, start_b int, end_b int")
    with pytest.raises(tokens.MatcherError):
        tokens.token_clones(files, (".js",), 60, 5, stray)
    pairs, seen, notes = tokens.token_clones(files, (".js",), 60, 5, glob_safe=True)
    assert pairs.count() == 0 and [r["path"] for r in seen.collect()] == ["a.js"] and len(notes) == 1


def test_token_runs_match_brute_force(spark):
    draw = random.Random(3)
    text = lambda n: [draw.choice("abcdefgh") + str(draw.randrange(5)) for _ in range(n)]
    shared = text(70)
    bodies = {f"{i}.js": " \n".join([*text(40), *(shared if i % 2 else shared[:50]), *text(30)]) for i in range(6)}
    got = tokens.match_tokens(inventory(spark, bodies), 60, 5).collect()
    linked = {frozenset((r["path_a"], r["path_b"])) for r in got}
    assert set().union(*linked) == {"1.js", "3.js", "5.js"} and all(r["tokens"] >= 60 for r in got)


def longest_common(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, max(row))
    return best


def test_no_token_run_is_lost_in_a_crowd(spark):
    draw = random.Random(11)
    text = lambda n: [draw.choice("abcdefgh") + str(draw.randrange(500)) for _ in range(n)]
    core, wide = text(50), text(64)
    bodies = [[*text(20), *core, *text(20)] for _ in range(12)] + [[*text(15), *wide, *text(15)] for _ in range(6)]
    for middle in (core, wide):  # two pairs of files, each with more in common around what all share
        for _ in range(2):
            left, right = text(12), text(13)
            bodies += [[*text(9), *left, *middle, *right, *text(9)] for _ in range(2)]
    draw.shuffle(bodies)
    bodies += bodies[:3]
    files = {f"{i:02d}.js": " \n".join(b) for i, b in enumerate(bodies)}
    files["flat.js"] = " ".join(wide)  # on one line, so in no run, and not to stand between others
    got = tokens.match_tokens(inventory(spark, files), 60, 5).collect()
    assert all("flat.js" not in (r["path_a"], r["path_b"]) for r in got)
    want = {(a, b): n for a, b in combinations(range(len(bodies)), 2) if (n := longest_common(bodies[a], bodies[b])) >= 60}
    assert len({n for n in want.values()}) >= 4
    for (a, b), n in want.items():  # linked through files that share as much
        reached = {f"{a:02d}.js"}
        while more := {p for r in got if r["tokens"] >= n for p in (r["path_a"], r["path_b"]) if {r["path_a"], r["path_b"]} & reached} - reached:
            reached |= more
        assert f"{b:02d}.js" in reached


def test_every_customer_is_an_entry(spark, tmp_path):
    from twinsift.plans.queries import QUERIES

    made = {"customer": [(1, "BUILDING"), (2, "OTHER")], "orders": [(10, 1), (20, 2), (30, 9)], "lineitem": [(10, 100, 5), (20, 200, 5), (30, 300, 6)], "part": [(100,), (200,), (300,), (400,)]}
    columns = {"customer": "c_custkey bigint, c_mktsegment string", "orders": "o_orderkey bigint, o_custkey bigint", "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint", "part": "p_partkey bigint"}
    for name, rows in made.items():
        spark.createDataFrame(rows, columns[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = lambda name: {r["id"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("whole_reachable") == {"c1", "c2", "o10", "o20", "p100", "p200", "s5"}
    assert got("whole_dead_nodes") == {"p300", "p400"}


def test_mutants_and_recall(spark):
    files = inventory(spark, {"a.js": ORDER_TOTAL})
    config = Config()
    sampled = calibrate.candidates(files, config.structure)
    made = calibrate.mutants(sampled, config.structure, 1)
    texts = {r["kind"]: r["text"] for r in made.collect()}
    assert set(texts) >= {"copy", "rename", "literals", "insert-statement"}
    assert "total_renamed" in texts["rename"] and "negative pricex" in texts["literals"] and "inserted" in texts["insert-statement"]
    for t in texts.values():
        script.match_brackets(script.lex(t))
    rates = {r["kind"]: (r["attempted"], r["detected"], r["recall"]) for r in calibrate.recall(made, made.where("kind = 'copy'")).collect()}
    assert rates["copy"] == (1, 1, 1.0) and rates["rename"] == (1, 0, 0.0) and rates["overall"][0] == made.count()


def test_seeded_draws(spark):
    frame = spark.range(50)
    first = [r["id"] for r in calibrate.draw(frame, 1, 10, "id").collect()]
    assert first == [r["id"] for r in calibrate.draw(frame.repartition(7), 1, 10, "id").collect()] != [r["id"] for r in calibrate.draw(frame, 2, 10, "id").collect()]
    numbers = calibrate.seeded_random(1)
    assert sorted(calibrate.shuffled(range(9), numbers)) == list(range(9)) and all(0 <= numbers() < 1 for _ in range(100))


def test_stream_reports_each_key_once(spark, tmp_path):
    from twinsift.streaming.incremental import watch_keys

    schema = "normalized_key string, seen_at timestamp, repo string"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([("a", None, "r"), ("a", None, "r"), (None, None, "r")], schema).coalesce(1).write.parquet(source)
    for expected in (1, 2):
        watch_keys(spark.readStream.schema(schema).parquet(source), "normalized_key", out, check).awaitTermination()
        assert spark.read.parquet(out).count() == expected
        spark.createDataFrame([("a", None, "r"), ("b", None, "r")], schema).coalesce(1).write.mode("append").parquet(source)


def test_windows_of_a_stream_leave_out_late_rows(spark, tmp_path):
    from datetime import datetime

    from twinsift.streaming.incremental import windowed_deliveries

    schema = "rule_id bigint, repo string, seen_at timestamp"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    day = lambda d, h=1: datetime(2024, 3, d, h)
    batches = ([(1, "r", day(1)), (2, "r", day(1, 5)), (3, "s", day(1)), (4, "r", None), (5, "r", day(9))], [(6, "r", day(1)), (7, "r", day(9)), (8, "r", day(20))], [(9, "r", day(28))])
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        counted = windowed_deliveries(spark.readStream.schema(schema).parquet(source), "seen_at")
        counted.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["start"].day, r["repo"], r["deliveries"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, "r", 2), (1, "s", 1), (9, "r", 2), (20, "r", 1)]  # the second batch's row of the first day came too late


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from twinsift import session

    nothing = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: nothing, master="spark://host:7077"), conf=nothing)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)
    cluster.sparkContext.master = "local[4]"
    assert session.shared_dir(cluster).startswith("file:")


def test_public_names():
    import twinsift

    assert all(getattr(twinsift, name) is not None for name in twinsift.__all__) and "run_audit" in twinsift.__all__
    with pytest.raises(AttributeError):
        twinsift.nothing


def test_needles_with_a_common_beginning(spark):
    """Half of all names begin alike, and so do the texts: the rarest run of each name looks it up."""
    names = [(i, f"getOrder{chr(97 + i)}{chr(110 + i % 9)}", "") for i in range(12)]
    texts = [(f"{i}.json", i, "getOrder " * 20 + (names[i % 12][1] if i % 3 == 0 else "")) for i in range(40)] + [("n.json", 50, None), ("e.json", 51, "")]
    got = {r["needle"]: r["path"] for r in reach.mentions(spark.createDataFrame(names, "id int, needle string, exclude string"), spark.createDataFrame(texts, "path string, ord int, text string")).collect()}
    want = {}
    for _, needle, _ in names:
        held = [(o, p) for p, o, t in texts if t and needle in t]
        if held:
            want[needle] = min(held)[1]
    assert got == want and len(want) == 4

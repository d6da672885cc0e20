import json
import subprocess

from tests.conftest import ORDER_TOTAL, inventory
from twinsift.config import Config, Structure
from twinsift.operators.ted import similarity
from twinsift.operators.detectors import CssDetector, DeadCodeDetector, StructureDetector, TokensDetector
from twinsift.plans.audit import run_audit
from twinsift.sources.css import read_rules
from twinsift.sources.project import Manifest
from twinsift.sources.script import read_units

RENAMED = ORDER_TOTAL.replace("items", "rows").replace("total", "sum").replace("0;", "7;").replace("orderTotal", "orderTotal")
MODIFIED = ORDER_TOTAL.replace("  let total = 0;\n", "  let total = 0;\n  if (items.length === 0) return 0;\n")
UNRELATED = """function describeUser(user, locale) {
  const parts = [user.first, user.last].filter(Boolean).join(" ");
  switch (locale) {
    case "de":
      return `Name: ${parts}`;
    case "fr":
      return `Nom: ${parts}`;
    default:
      console.warn(locale, parts.length > 3 ? parts : null);
      return parts.trim().toLowerCase();
  }
}
"""
RULE = "a {\n  color: red;\n  margin: 0;\n  padding: 1px;\n}\n"


def kinds(result):
    return sorted((r["kind"], r["similarity"]) for r in result.clusters.collect())


def structure(spark, second, config=Config()):
    return StructureDetector(config).run(inventory(spark, {"a.js": ORDER_TOTAL, "b.js": second}))


def pair_kind(first, second):
    """What the detector would call two functions, from their keys and trees."""
    (a,), (b,) = read_units(first), read_units(second)
    if a.normalized == b.normalized:
        return "identical" if a.raw == b.raw else "normalized"
    return "near-miss" if similarity((a.labels, a.leftmost), (b.labels, b.leftmost), 0.85) >= 0.85 else None


def test_kinds_of_function_pairs():
    assert pair_kind(ORDER_TOTAL, ORDER_TOTAL.replace("  let", "  // a note\n    let")) == "identical"
    assert pair_kind(ORDER_TOTAL, RENAMED) == "normalized"
    assert pair_kind(ORDER_TOTAL, MODIFIED) == "near-miss"
    assert pair_kind(ORDER_TOTAL, UNRELATED) is None
    assert pair_kind(ORDER_TOTAL, ORDER_TOTAL.replace("item.price * item", "item.cost * item")) == "near-miss"
    assert pair_kind(ORDER_TOTAL, ORDER_TOTAL.replace("total + tax", "total - tax")) == "near-miss"
    recursive = ORDER_TOTAL.replace("return Math", "if (gross > 9) return orderTotal([], taxRate);\n  return Math")
    assert pair_kind(recursive, recursive.replace("orderTotal", "sumUp")) == "normalized"


def test_forms_and_names_of_functions():
    body = ORDER_TOTAL[ORDER_TOTAL.index("(") :].replace(") {", ") => {", 1).rstrip()
    forms = [f"const f = {body};", f"const o = {{ f: {body} }};", f"class C {{ f = {body}; }}"]
    assert [pair_kind(forms[0], f) for f in forms[1:]] == ["identical", "identical"]
    method = ORDER_TOTAL.replace("function orderTotal", "  total")
    assert [u.name for u in read_units(f"class Cart {{\n{method}\n{method.replace('total(', 'constructor(')}}}\n")] == ["Cart.total", "constructor"]


def test_edited_copy_is_a_near_miss_cluster(spark):
    ((kind, weakest),) = kinds(structure(spark, MODIFIED))
    assert kind == "near-miss" and 0.85 <= weakest < 1


def test_broken_file_is_a_failure_and_not_analyzed(spark):
    result = structure(spark, "function broken( {\n")
    assert [r["path"] for r in result.failures.collect()] == ["b.js"]
    assert [r["path"] for r in result.analyzed.collect()] == ["a.js"]


def test_oversized_functions_match_exactly_only(spark):
    config = Config(structure=Structure(maxTedNodes=20))
    assert kinds(structure(spark, MODIFIED, config)) == []
    result = structure(spark, ORDER_TOTAL, config)
    assert kinds(result) == [("identical", 1.0)] and "20 nodes" in result.notes[0]


def test_css_keys():
    keys = lambda text: [(r["normalized_key"], r["raw_key"]) for r in read_rules(text)]
    ((normal, raw),) = keys(RULE)
    assert keys(RULE.replace("a {", "b {")) == [(normal, raw)]
    ((other, spelled),) = keys(RULE.replace("color: red;\n  margin: 0;", "MARGIN:   0;\n  color: RED;"))
    assert other == normal and spelled != raw
    assert keys(RULE.replace("red", "url(A)")) != keys(RULE.replace("red", "url(a)"))
    assert keys(f"@media (min-width: 1px) {{\n{RULE}}}\n")[0][0] != normal
    assert keys("a {\n  color: red;\n  top: 0;\n}\n") == []


def test_css_near_miss_and_lines(spark):
    ten = "".join(f"  p{i}: {i};\n" for i in range(10))
    result = CssDetector(Config()).run(inventory(spark, {"a.css": f"a {{\n{ten}}}\n\nb {{\n{ten}  extra: 1;\n}}\n"}))
    (row,) = result.clusters.collect()
    assert (row["kind"], row["similarity"]) == ("near-miss", 10 / 11)
    assert sorted(r["start_line"] for r in result.members.collect()) == [1, 14]
    broken = CssDetector(Config()).run(inventory(spark, {"a.css": "a {\n color: red;\n"}))
    assert broken.failures.count() == 1 and broken.analyzed.count() == 0


def dead(spark, files, entry=("index.ts",), **kwargs):
    from twinsift.config import DeadCode

    result = DeadCodeDetector(Config(deadcode=DeadCode(entry=tuple(entry))), **kwargs).run(inventory(spark, files))
    return sorted((r["kind"], r["path"], r["name"]) for r in result.findings.collect()), result


def test_dead_files_and_exports(spark):
    files = {
        "index.ts": "import { live } from './live';\nimport { used } from './lib';\nimport './main.css';\nimport * as x from './a';\nexport * from './b';\nimport c = require('./c');\ntype T = import('./d').T;\nlive(); used(); x; c;\n",
        "live.ts": "export function live() {}\n",
        "dead.ts": "import { helper } from './helper.js';\nhelper();\n",
        "helper.ts": "export function helper() {}\n",
        "m.ts": "import './n';\n",
        "n.ts": "import './m';\n",
        "main.css": "@import 'used.css';\n/* @import 'commented.css'; */\n",
        "used.css": "a{}\n",
        "commented.css": "a{}\n",
        "lib.ts": "export function used() {}\nexport function unused() {}\nexport const inner = 1;\nconsole.log(inner);\n",
        **{f"{k}.ts": f"export const {k}1 = 1;\nexport type T = 1;\n" for k in "abcd"},
    }
    found, _ = dead(spark, files)
    assert [x[1] for x in found if x[0] == "dead-file"] == ["commented.css", "dead.ts", "helper.ts", "m.ts", "n.ts"]
    assert [x for x in found if x[0] != "dead-file"] == [("dead-export", "lib.ts", "unused")]


def test_mentions_make_findings_uncertain(spark):
    files = {"index.ts": "const name = pick();\nrequire('./plugins/' + name);\nconst known = 'special-plugin';\n", "special-plugin.ts": "export {};\n", "widget-box.ts": "export {};\n", "page.html": "<script src='widget-box.js'></script>\n"}
    assert dead(spark, files)[0] == [("uncertain-file", "special-plugin.ts", None), ("uncertain-file", "widget-box.ts", None)]


def test_without_entries_nothing_is_analyzed(spark):
    found, result = dead(spark, {"lib/a.ts": "export {};\n"}, entry=())
    assert found == [] and result.analyzed.count() == 0 and len(result.notes) == 1


def test_manifest_entries_and_tests_are_roots(spark):
    files = {"src/app/start.ts": "import '../lib';\n", "src/lib.ts": "export {};\n", "src/orphan.ts": "export {};\n", "src/util.ts": "export const helper = 1;\n", "src/util.test.ts": "import { helper } from './util';\nhelper;\n"}
    found, _ = dead(spark, files, entry=(), manifest=Manifest(entries=("./dist/app/start.js",)))
    assert found == [("dead-file", "src/orphan.ts", None)]


def test_token_runs(spark):
    run = "\n".join(f"call{i}(value{i}, {i});" for i in range(12))
    files = {"a.js": f"start\n{run}\nend();\n", "b.js": f"other\n{run}\nfinish();\n", "c.js": "x();\n"}
    result = TokensDetector(Config()).run(inventory(spark, files))
    rows = sorted((r["path"], r["start_line"], r["end_line"]) for r in result.members.collect())
    assert rows == [("a.js", 2, 13), ("b.js", 2, 13)]
    assert result.analyzed.count() == 3


def test_audit_counts_lines_gates_and_baseline(spark):
    files = inventory(spark, {"a.js": ORDER_TOTAL, "b.js": ORDER_TOTAL, "c.js": UNRELATED, "s.css": RULE + RULE.replace("a {", "b {"), "x.vue": "one\ntwo\n"})
    config = Config(detectors=("tokens", "structure", "css"))
    audit = run_audit(files, config)
    assert audit.numbers["duplication"]["clusterCount"] == 2
    assert audit.numbers["duplication"]["duplicatedLines"] == 12 + 5
    assert [r["savable"] for r in audit.clusters.orderBy("savable", ascending=False).collect()] == [12, 5]
    assert {r["ext"]: r["lines"] for r in audit.uncovered.collect()} == {".vue": 2}
    assert not audit.passed
    again = run_audit(files, config, baseline=audit.fingerprints)
    assert again.numbers["duplication"]["baseline"] == {"baselinedClusterCount": 2, "newClusterCount": 0, "newPercent": 0.0}
    assert {g["gate"]: g["passed"] for g in again.gates}["duplication"]


def test_command_line(spark, tmp_path, capsys):
    from twinsift import cli

    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for name in ("a.js", "b.js"):
        (tmp_path / name).write_text(ORDER_TOTAL)
    assert cli.run([str(tmp_path)]) == 1
    document = json.loads((tmp_path / ".twinsift/report.json").read_text())
    assert document["duplication"]["clusterCount"] == 1
    sarif = json.loads((tmp_path / ".twinsift/report.sarif").read_text())
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) >= 1
    assert cli.run(["baseline", str(tmp_path)]) == 0
    (tmp_path / "twinsift.config.json").write_text(json.dumps({"baseline": {"enabled": True}}))
    assert cli.run([str(tmp_path)]) == 0
    assert cli.run(["calibrate", str(tmp_path), "--samples", "5"]) == 0
    assert "rename" in (tmp_path / ".twinsift/calibration.json").read_text()
    assert cli.run([str(tmp_path), "--config", "missing.json"]) == 2
    assert cli.run([str(tmp_path), "--min-lines", "0"]) == 2
    outside = tmp_path / "outside"
    outside.mkdir()
    assert cli.run(["/proc"]) == 2

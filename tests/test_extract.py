import json

from pyspark.sql import functions as F

from stratagraph.functions import profiles
from stratagraph.operators import extract, report


def found(spark, text, path="a.ts"):
    return extract.facts(spark.createDataFrame([("r", path, text), ("r", "null.ts", None), ("r", "empty.ts", "")], "repo_id string, path string, text string"))


def names(df):
    return [(r.kind, r.raw_import, r.line, r.column) for r in extract.imports(df).orderBy("line", "column").collect()]


def test_script_imports(spark):
    text = "\n\n  import x from './x'\n// import './no'\nexport * from \"./y\";\nimport {\n a,\n} from './multi'\nconst s = 'require(\"./str\")', f = require('./f'), g = o.require('./o'), h = import(`./t`);\né; import('./dyn')\n"
    assert names(found(spark, text)) == [("import", "./x", 1, 1), ("export_from", "./y", 4, 1), ("require", "./f", 9, 35), ("dynamic_import", "./dyn", 10, 5)]


def test_class_facts(spark):
    text = "import D, {A as B, type T} from './m';\nimport * as ns from './n';\nimport './side';\nexport default class X {}\nclass Y {}\nconst Z = class W {};\nexport { Y as Yy, q };\nnew Y(); new ns.B(); new B();\n// class No\n"
    f = found(spark, text)
    assert sorted(r.name for r in extract.classes(f).collect()) == ["X", "Y"]
    assert sorted((r.export_name, r.local_class) for r in extract.exports(f).collect()) == [("Yy", "Y"), ("default", "X")]
    assert [(r.class_name, r.is_identifier) for r in extract.constructions(f).orderBy("column").collect()] == [("Y", True), ("ns", False), ("B", True)]
    assert {(r.kind, r.local, r.imported, r.module) for r in extract.bindings(f).collect()} == {("default", "D", "default", "./m"), ("named", "B", "A", "./m"), ("named", "T", "T", "./m"), ("namespace", "ns", "*", "./n"), ("side_effect", None, None, "./side")}


def test_php(spark):
    text = "<p>use No\\One;</p>\n<?php\nuse A\\B, C\\D as E;\nuse F\\{G, H\\I as J};\nclass K { use Trait_; function f() { return function() use ($x) { }; } }\nrequire_once __DIR__ . '/l.php';\n// use No\\Two;\n"
    assert [r[:2] for r in names(found(spark, text, "a.php"))] == [("php_use", "A\\B"), ("php_use", "C\\D"), ("php_use", "F\\G"), ("php_use", "F\\H\\I"), ("php_include", "/l.php")]
    broken = found(spark, "<?php use A; function (", "b.php")
    assert extract.imports(broken).count() == 0 and extract.parse_errors(broken).first().path == "b.php"


def test_profiles(spark):
    rows = [("nextjs", "app/(shop)/@m/[id]/p.ts", "app/(group)/@slot/[param]/p.ts"), ("react", "src/__tests__/a.test.tsx", "src/tests/a.tsx"), ("react_native", "a.ios.ts", "a.platform.ts"), ("angular", "x/:id/app-routing.ts", "x/[param]/app-routes.ts"), ("react_router", "r/$u/_index.$id.ts", "r/[param]/index.[param].ts"), ("generic", "a/[x]/b.ts", "a/[x]/b.ts")]
    for profile, path, expected in rows:
        once = profiles.normal_file(profile, F.col("p"))
        got = spark.createDataFrame([(path,)], "p string").select(once.alias("p")).select("p", profiles.normal_file(profile, F.col("p"))).first()
        assert tuple(got) == (expected, expected)


def test_detection(spark):
    rows = [("n", "next.config.js", None), ("w", "package.json", '{"next": 1}'), ("r", "package.json", '{"react": 1}'), ("r", "src/a.js", None), ("d", "a/b/c/package.json", '{"@angular/core": 1}'), ("t", "angular.json", None), ("t", "src/routes/a.ts", None)]
    got = {r.repo_id: r.framework for r in profiles.detect(spark.createDataFrame(rows, "repo_id string, path string, text string")).collect()}
    assert got == {"n": "nextjs", "w": "generic", "r": "react", "d": "generic", "t": "generic"}


def test_reports(spark):
    f = spark.createDataFrame([("r", "A", "no_import", "error", "bad", "a.ts", 0, 2, "./b", "f1", "")], "repo_id string, rule_id string, rule_kind string, severity string, message string, file_path string, line int, column int, raw_import string, fingerprint string, details string")
    assert "details" not in json.loads(report.json_findings(f).first().json)
    region = json.loads(report.sarif_results(f).first().json)["locations"][0]["physicalLocation"]["region"]
    assert region == {"startLine": 1, "startColumn": 2}
    assert json.loads(report.sarif_rules(f).first().json)["help"] == {"markdown": "bad"}
    assert report.text_findings(f).first().text == "  - a.ts:0:2 bad (import: ./b)"


def test_workspaces_and_catalog(spark):
    files = spark.createDataFrame([("r", "apps/a/x.ts"), ("r", "apps/ab/y.ts"), ("r", "z.ts")], "repo_id string, path string")
    roots = spark.createDataFrame([("r", "apps/a"), ("r", "apps")], "repo_id string, root string")
    assert sorted((r.root, r.path) for r in report.in_workspaces(files, roots).collect()) == [("apps", "apps/a/x.ts"), ("apps", "apps/ab/y.ts"), ("apps/a", "apps/a/x.ts")]
    m = spark.createDataFrame([("r", "HIGH"), ("r", "MEDIUM"), ("r", "LOW")], "repo_id string, confidence string")
    assert [report.adopted(m, x).count() for x in ("medium", " HIGH", "odd")] == [2, 1, 1]


def test_forms_hold_what_they_state():
    from stratagraph.plans.source_forms import FORMS, LONG, SCRIPTS

    for i, (text, want) in enumerate(FORMS):
        got = [(*x[2:7], x[8]) for x in extract.file_facts("r", "a.tsx" if i < len(SCRIPTS) else "a.PHP", text.replace("TAB", LONG).replace("~", "7"))]
        assert sorted(map(str, got)) == sorted(str(tuple(v.replace("~", "7") if isinstance(v, str) else v for v in row)) for row in want), text


def test_php_that_parses():
    good = [
        "<?php #[Attr(1)] final class A extends B implements C, D { use T; const int X = 1; private ?Foo $x = null; public function &m(A|B $a, string &$b = 'x'): static { return new class($a) extends Z {}; } }",
        "<?php $o->{$name}->class; Foo::class; A::$b; $$c = (int) $d; @f(); $i++; ++$j; !$k; f(a: 1, b: 2); $x = $a ?: 3; strlen(...); $x = &$y; static $z = 1; list($a, $b) = $c; goto end; end: echo 1;",
        "<?php enum S: string { case A = 'a'; } declare(strict_types=1); namespace A\\B { function f(): void {} } switch ($x): case 1: break; default: endswitch;",
        "<?php try { f(); } catch (A | B $e) { } finally { } abstract class Q { abstract protected function f(); } interface I extends J {} trait T { public $x; }",
        "no php { ( '",
        "<?php if ($a) return; else if ($b) echo 1; else { } $f = fn(int ...$x): ?int => $x[0] ?? -1; for ($i = 0; $i < 3; $i++, $j--): endfor; print $a; exit; return ['a' => 1] + $b;",
    ]
    bad = ["<?php class { }", "<?php endif;", "<?php use ;", "<?php foreach ($a as) { }", "<?php } ", "<?php $a = 1", "<?php new ;", "<?php $a foo;", "<?php 'open", "<?php f(* 2);", "<?php /* open"]
    for text, broken in [(t, False) for t in good] + [(t, True) for t in bad]:
        assert ("parse_error" in [x[0] for x in extract.php_facts(text)]) is broken, text


def test_odd_ends_and_long_files():
    """Unclosed modes end with the text, and a long file of many facts takes time in proportion."""
    import time

    for text in ["`${", "`\\", "<a", "<a>{", "<a b={`", "'", "/*", "a\\", "<A b='", "x = </", "new", "class", "export {", "import {a", "import type", "new ("]:
        list(extract.js_facts(text))
    for text in ["<?php \"{$a", "<?php `\\", "<?php <<<A\n", "<?php use A\\{", "<?php include", "<?", "<?php \\"]:
        list(extract.php_facts(text))
    began = time.time()
    assert sum(1 for _ in extract.file_facts("r", "a.tsx", "const a = <p>it's {new A()}</p>;\n" * 40000)) == 40000
    assert time.time() - began < 30

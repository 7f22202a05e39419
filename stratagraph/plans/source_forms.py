"""Extraction over sources of many forms, one for each customer, with what each form holds stated beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.operators import extract
from stratagraph.sources.tabular import table

BROKEN = [("parse_error", None, None, None, 1, None)]
# Text and facts (fact, kind, name, other, line, flag); ~ stands for the customer's number, TAB for a text that holds more than two hundred characters.
SCRIPTS = [
    ("const a = <p>Don't</p>;\nclass A~ {}\nnew A~();\n", [("class", None, "A~", None, 2, None), ("new", None, "A~", None, 3, True)]),
    ("const q = /[\"']/;\nexport class B~ {}\nnew B~();", [("class", None, "B~", None, 2, None), ("export", None, "B~", "B~", 2, True), ("new", None, "B~", None, 3, True)]),
    ("const t = `${new C~()} it's`;\nclass D~ {}", [("new", None, "C~", None, 1, True), ("class", None, "D~", None, 2, None)]),
    ("const f = <T,>(x: T) => x;\nclass E~<T> {}\nnew E~<string>();", [("class", None, "E~", None, 2, None), ("new", None, "E~", None, 3, True)]),
    ("if (x) /it's/.test(y);\nexport default class F~ extends G {}", [("class", None, "F~", None, 2, None), ("export", None, "default", "F~", 2, True)]),
    ("const c = class H~ {};\nabstract class I~ {}\nnew (foo())();", [("new", None, "", None, 3, False)]),
    ("const j = a / b / new J~();\nconst s = 'new No()'; // new No()", [("new", None, "J~", None, 1, True)]),
    ("return <Foo on={() => { new K~() }} title=\"it's\">{new L~()} don't <b/></Foo>;\nclass M~ {}", [("new", None, "K~", None, 1, True), ("new", None, "L~", None, 1, True), ("class", None, "M~", None, 2, None)]),
    ("const x = /* TAB */ class N~ {};\n/* TAB */ class O~ {}", [("class", None, "O~", None, 2, None)]),
    ("import type { A, type B as Bb } from './t~';\nimport D, * as ns from './n~';", [("import", "import", "./t~", None, 1, None), ("import", "import", "./n~", None, 2, None), ("binding", "named", "A A", "./t~", 1, None), ("binding", "named", "Bb B", "./t~", 1, None), ("binding", "default", "D default", "./n~", 2, None), ("binding", "namespace", "ns *", "./n~", 2, None)]),
    ("interface P { new (x: string): P~; }\ntype Q = new () => Q~;\nnew this.r(); x.new(1);", [("new", None, "", None, 3, False)]),
    ("class R~ {}\nexport { R~ as default, z };", [("class", None, "R~", None, 1, None), ("export", None, "default", "R~", 2, True), ("export", None, "z", "z", 2, False)]),
    ("export { S~ } from './s~';\nexport * from './u~';", [("import", "export_from", "./s~", None, 1, None), ("import", "export_from", "./u~", None, 2, None)]),
    ("namespace V { export class V~ {} }\nnew V.V~();", [("class", None, "V~", None, 1, None), ("export", None, "V~", "V~", 1, True), ("new", None, "V", None, 2, False)]),
    ("@Dec({ a: new W~() })\nclass X~ { m() { return new X~; } }", [("new", None, "W~", None, 1, True), ("class", None, "X~", None, 2, None), ("new", None, "X~", None, 2, True)]),
    ("function f() {}\n/it's/.exec(a); class Y~ {}\nimport './z~';", [("class", None, "Y~", None, 2, None), ("import", "import", "./z~", None, 3, None), ("binding", "side_effect", None, "./z~", 3, None)]),
]
PHP = [
    ("<?php\n$x = <<<EOT\nit's { here\nEOT;\nuse A~\\B;", [("import", "php_use", "A~\\B", None, 5, None)]),
    ("<?php\n$x = <<<'E'\n\"{ (\n  E . 'a';\nuse C~\\{D, E as F};", [("import", "php_use", "C~\\D", None, 5, None), ("import", "php_use", "C~\\E", None, 5, None)]),
    ("<?php if ($a): ?>\n<b>(</b> it's\n<?php else: require 'p~.php'; endif;", [("import", "php_include", "p~.php", None, 3, None)]),
    ("<?php $f = \"{$v[\"x\"]} use No\\One; it's\";\nuse G~\\H;", [("import", "php_use", "G~\\H", None, 2, None)]),
    ("<?php class I { use T; function f() { return function () use ($x) { include __DIR__ . '/q~.php'; }; } }\nuse function J~\\f;", [("import", "php_include", "/q~.php", None, 1, None), ("import", "php_use", "J~\\f", None, 2, None)]),
    ("<?php $o = new class extends A { use T; };\n#[At('use No;')]\nfinal class Z { }\nuse K~\\L; // use No\\Two;", [("import", "php_use", "K~\\L", None, 4, None)]),
    ("<?php echo match ($x) { 1, 2 => 'a', default => throw new E() };\ninclude_once(\"r~.php\");", [("import", "php_include", "r~.php", None, 2, None)]),
    ("<?php while ($a) $b--; foreach ($c as $k => [$d, $e]): echo $d ?: `ls {$x}`; endforeach ?>\nuse No\\One; <?= include 's~.php' ?>", [("import", "php_include", "s~.php", None, 2, None)]),
    *((f"<?php use M~\\N; {end}", BROKEN) for end in ("function (", "$x = ;", "echo 'a' 'b';", "if $x { }", "f(1;", "{ ]", "$a = 1 $b = 2;", '"open', "if ($a): echo 1;", "function f() { return 1 }", "$y = (1 + );", "$z = <<<EOT\nabc")),
]
FORMS = SCRIPTS + PHP
LONG = "long " * 60


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    form = (k % len(FORMS)).cast("int")
    text = F.replace(F.replace(F.get(F.array(*(F.lit(x) for x, _ in FORMS)), form), F.lit("TAB"), F.lit(LONG)), F.lit("~"), k.cast("string"))
    end = F.when(form < len(SCRIPTS), ".tsx").otherwise(".php")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), k % 4).alias("repo_id"), F.concat(F.lit("c"), k, end).alias("path"), text.alias("text"))


def _sql(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, bool)) else "'" + value.replace("'", "''") + "'"


ROWS = ", ".join(f"({i}, {', '.join(map(_sql, row))})" for i, (_, facts) in enumerate(FORMS) for row in facts)
FORMS_SQL = f"""
WITH x(form, fact, kind, name, other, line, flag) AS (VALUES {ROWS})
SELECT 'm' || c_custkey % 4 AS repo_id, 'c' || c_custkey || CASE WHEN form < {len(SCRIPTS)} THEN '.tsx' ELSE '.php' END AS file, fact, kind::VARCHAR AS kind, replace(name, '~', c_custkey::VARCHAR) AS name, replace(other, '~', c_custkey::VARCHAR) AS other, line, flag
FROM customer JOIN x ON c_custkey % {len(FORMS)} = form"""


def extract_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.facts(sources(spark, sf_dir)).drop("column")


QUERIES = {"extract_forms": extract_forms}
SQL = {"extract_forms": FORMS_SQL}

"""Rules met by keys find what rules evaluated one by one find."""

from __future__ import annotations

import random

import pytest

from stratagraph.operators import policy
from stratagraph.operators.policy import Rule
from stratagraph.operators.rule_index import evaluate_indexed, glob_keys

IMPORTS = "repo_id string, source_file string, raw_import string, resolved_path string, is_package boolean, line int, column int, kind string"
GLOBS = ["**", "*", "", "src/**", "src/domain/**", "src/*/a.ts", "**/infra/**", "**/*.ts", "*.test.ts", "{src,lib}/**/*.{ts,js}", "lib/[ab]/**", "src/domain/a.ts", "**/x?.js", "{bad", "[", "./src//ui/**", "lib\\a\\**", "**/ui/*", "src", "**/**", "/abs/**", "a..ts"]
PACKAGES = ["axios", "@scope/*", "@scope/ui", "lodash/**", "**", "*", "node:fs", "{axios,react}", "[", "@scope/ui/deep", "**/ui/**"]
WORDS = ["src", "lib", "domain", "infra", "ui", "a", "b"]
NAMES = ["a.ts", "b.test.ts", "x1.js", "c.js", "README", ".ts", "a..ts", "d.ts\n"]
RAW = ["axios", "axios/x", "@scope/ui", "@scope/ui/deep", "@scope/other", "lodash/fp/map", "react", "node:fs", "", "lodash//fp", "a/ui/b"]


def paths(r: random.Random, n: int) -> list[str]:
    return ["/".join([*(r.choice(WORDS) for _ in range(r.randrange(4))), r.choice(NAMES)]) for _ in range(n)] + ["/abs/x.ts", "src"]


def made(seed: int) -> list[Rule]:
    r = random.Random(seed)
    some = lambda xs, least=1: [r.choice(xs) for _ in range(r.randrange(least, 3))]
    rules = []
    for k in range(60):
        kind = ("no_import", "no_package", "file_pattern", "pattern", "construction")[k % 5]
        target = {"no_package": PACKAGES, "file_pattern": ["^[a-z][.]ts$", "^.*[.]js$", "(?P<n>a)[.]"]}.get(kind, GLOBS)
        template = {"pattern": "dependency_constraint", "construction": "construction_policy"}.get(kind, "")
        relation = r.choice(["imports", "packages", ""]) if kind == "pattern" else ""
        rules.append(Rule(f"R{k % 50}", "pattern" if template else kind, r.choice(["error", "warning"]), some(GLOBS), some(PACKAGES if relation == "packages" else target), some(GLOBS, 0), template, {"relation": relation} if relation else {}, r.choice(["", "own"])))
    return rules


@pytest.mark.parametrize("seed", [1, 2])
def test_indexed_rules_find_what_evaluated_ones_find(spark, seed):
    r = random.Random(seed)
    every = paths(r, 60)
    files = spark.createDataFrame([(f"r{k % 2}", p) for k, p in enumerate(every)] + [("r0", None), ("r0", every[0])], "repo_id string, path string")
    rows = [(f"r{k % 2}", p, "./x", r.choice([*every, None, ""]), False, k, 1, "import") for k, p in enumerate(every)]
    rows += [(f"r{k % 2}", p, r.choice(RAW), None, True, k, 2, "import") for k, p in enumerate(every)] + [("r1", None, "axios", None, True, 1, 1, "import"), rows[0]]
    imports = spark.createDataFrame(rows, IMPORTS)
    built = spark.createDataFrame([(f"r{k % 2}", p, k, 1, "Mailer", r.random() < 0.8, r.random() < 0.8) for k, p in enumerate(every)], "repo_id string, file string, line int, column int, class_name string, is_resolved boolean, is_service boolean")
    rules = made(seed)
    want = sorted(map(str, policy.evaluate(rules, files, imports, built).collect()))
    got = sorted(map(str, evaluate_indexed(rules, files, imports, built).collect()))
    assert len(want) > 100 and got == want


def test_a_plan_does_not_grow_with_rules(spark):
    files = spark.createDataFrame([("r", f"src/m{k}/a.ts") for k in range(50)], "repo_id string, path string")
    imports = spark.createDataFrame([("r", f"src/m{k}/a.ts", "../b", f"src/m{(k * 7) % 50}/b.ts", False, 1, 1, "import") for k in range(50)], IMPORTS)
    rules = [Rule(f"N{k}", "no_import", "error", ["src/**"], [f"src/m{k}/**"]) for k in range(5000)]
    size = lambda found: len(found._jdf.queryExecution().optimizedPlan().canonicalized().treeString().splitlines())
    few, many = evaluate_indexed(rules[:10], files, imports), evaluate_indexed(rules, files, imports)
    assert size(few) == size(many)
    assert sorted(x.rule_id for x in many.collect()) == sorted(f"N{(k * 7) % 50}" for k in range(50))
    assert "Window" not in many._jdf.queryExecution().toString()


def test_no_rules_and_empty_tables(spark):
    files = spark.createDataFrame([], "repo_id string, path string")
    imports = spark.createDataFrame([], IMPORTS)
    assert evaluate_indexed([], files, imports).count() == 0
    found = evaluate_indexed([Rule("A", "no_import", "error", ["**"], ["**"]), Rule("B", "file_pattern", "error", ["["], ["x"]), Rule("C", "no_cycle", "error", ["**"])], files, imports)
    assert found.count() == 0 and found.columns == policy.evaluate([Rule("B", "file_pattern", "error", ["**"], ["x"])], files, imports).columns


def test_cycles_beside_indexed_rules(spark):
    files = spark.createDataFrame([("r", "a/x.ts"), ("r", "b/x.ts")], "repo_id string, path string")
    imports = spark.createDataFrame([("r", "a/x.ts", "../b", "b/x.ts", False, 1, 1, "import"), ("r", "b/x.ts", "../a", "a/x.ts", False, 1, 1, "import")], IMPORTS)
    rules = [Rule("A", "no_import", "error", ["a/**"], ["b/**"]), Rule("B", "no_cycle", "error", ["**"])]
    assert sorted(x.rule_id for x in evaluate_indexed(rules, files, imports).collect()) == ["A", "B"]


def test_keys_of_globs():
    assert glob_keys("src/domain/**") == {("head", "src/domain")}
    assert glob_keys("**/infra/*.ts") == {("segment", "infra")}
    assert glob_keys("**/*.test.ts") == {("extension", "ts")}
    assert glob_keys("{src,**}/x*") == {("head", "src"), ("any", "")}
    assert glob_keys("[") == set() and glob_keys(" ") == set()

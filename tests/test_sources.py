import pytest

from stratagraph.operators.catalog import boundary_matches
from stratagraph.operators.report import text_candidates
from stratagraph.operators.workspaces import workspace_patterns, workspace_roots
from stratagraph.sources.repository import contents, discovered, entries, walked

ENTRY = "repo_id string, path string, text string"
CANDIDATE = "repo_id string, kind string, scope string, target string, severity string, support long, violations long, prevalence double, confidence string, evidence string"


def paths(df):
    return sorted(r.path for r in df.collect())


def test_entries_are_relative_and_whole(spark, tmp_path):
    (tmp_path / "src/a b").mkdir(parents=True)
    (tmp_path / "src/a b/x.ts").write_text("import 'y'")
    (tmp_path / "root.php").write_text("<?php")
    (tmp_path / "empty.ts").write_text("")
    got = {r.path: bytes(r.content) for r in entries(spark, str(tmp_path), "r").collect()}
    assert got == {"src/a b/x.ts": b"import 'y'", "root.php": b"<?php", "empty.ts": b""}


def test_walk_lists_no_excluded_tree(spark, tmp_path):
    """Files of any level with their sizes; excluded and hidden directories are not listed, which one that cannot be read shows."""
    root = tmp_path / "repo"
    for name, text in {"a.ts": "x", "src/deep/er/b.ts": "import 'y'", "src/empty.ts": "", "src/.git/c.ts": "no", "node_modules/p/d.js": "no", "src/dist/e.js": "no", "s p/é.ts": "ü"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "node_modules/p").rename(root / "node_modules/q")
    before = {p: p.stat().st_atime_ns for p in (root / "node_modules", root / "node_modules/q", root / "src/.git", root / "src/dist")}
    got = walked(spark, str(root), ("**/node_modules", "node_modules", "**/dist"), "r").cache()
    assert {x.path: x.size for x in got.collect()} == {"a.ts": 1, "src/deep/er/b.ts": 10, "src/empty.ts": 0, "s p/é.ts": 2}
    assert all(p.stat().st_atime_ns == at for p, at in before.items())
    assert {x.path: bytes(x.content).decode() for x in contents(got, str(root)).collect()} == {"a.ts": "x", "src/deep/er/b.ts": "import 'y'", "src/empty.ts": "", "s p/é.ts": "ü"}
    (root / "bare").mkdir()
    assert walked(spark, str(root / "bare")).count() == 0


def test_discovered_prunes_directories(spark):
    rows = [("r", p, None) for p in ["src/a.ts", "src/a.gen.ts", "src/.git/b.ts", "src/dist/deep/c.ts", "src/d.php", "lib/e.js", "src/a.ts", ".hidden.ts", None]]
    files = spark.createDataFrame(rows, ENTRY)
    assert paths(discovered(files, ["**"], ["**/dist"], "javascript")) == [".hidden.ts", "lib/e.js", "src/a.ts"]
    assert paths(discovered(files, ["src/**"], [], "php")) == ["src/d.php"]
    assert paths(discovered(files, [], [], roots=("lib",))) == ["lib/e.js"]
    assert discovered(files.limit(0), [], ["x"]).count() == 0


@pytest.mark.parametrize(
    ("manifest", "text", "expected"),
    [
        ("package.json", '{"workspaces": ["packages/*", " ./apps/web/ "]}', ["apps/web", "packages/a", "packages/b"]),
        ("package.json", '{"workspaces": {"packages": ["packages/**"]}}', ["packages/a", "packages/b", "packages/b/in/c"]),
        ("package.json", "no json", []),
        ("pnpm-workspace.yaml", "packages:\n  - 'packages/a'\n  - \"apps/*\"\n", ["apps/web", "packages/a"]),
        ("turbo.json", None, ["apps/web", "packages/a", "packages/b"]),
    ],
)
def test_workspace_roots(spark, manifest, text, expected):
    held = ["packages/a", "packages/b", "packages/b/in/c", "apps/web", "packages/b/node_modules/z"]
    d = spark.createDataFrame([("r", f"{p}/package.json", "{}") for p in held] + [("r", manifest, text), ("other", "packages/a/package.json", "{}")], ENTRY)
    assert sorted(tuple(r) for r in workspace_roots(d).collect()) == [("r", p) for p in expected]


def test_package_json_comes_before_other_files(spark):
    d = spark.createDataFrame([("r", "package.json", '{"workspaces": []}'), ("r", "pnpm-workspace.yaml", "- x/*"), ("r", "nx.json", "")], ENTRY)
    assert [r.pattern for r in workspace_patterns(d).collect()] == ["x/*"]


def candidate(kind, scope, target, support=40, violations=0):
    return ("r", kind, scope, target, "warning", support, violations, violations / support, "MEDIUM", "e")


def test_boundary_matches_keep_the_best_of_equal_rules(spark):
    rows = [candidate("no_import", "src/domain/**", "src/infra/**"), candidate("no_import", "src/app/domain/**", "src/infra/**"), candidate("no_package", "src/domain/**", "axios"), candidate("no_package", "src/domain/**", "react"), candidate("no_import", "src/ui/**", "src/domain/**", 40, 30)]
    got = {(r.scope, r.target): r for r in boundary_matches(spark.createDataFrame(rows, CANDIDATE)).collect()}
    assert got["src/domain/**", "src/infra/**"].catalog_id == "CAT-LAYERED-DOMAIN-INFRA"
    assert got["src/domain/**", "src/infra/**"].score == pytest.approx(1.0)
    assert got["src/app/domain/**", "src/infra/**"].catalog_id == "CAT-LAYERED-DOMAIN-INFRA"
    assert got["src/domain/**", "axios"].relation == "packages" and ("src/domain/**", "react") not in got
    assert got["src/ui/**", "src/domain/**"].confidence == "HIGH" and len(got) == 4


def test_text_candidates(spark):
    rows = [candidate("no_import", "a/**", "b/**", 8, 1), ("r", "no_cycle", "a/**", None, "error", 3, 2, 1.0, "HIGH", "a <-> b")]
    got = [r.block.split("\n") for r in text_candidates(spark.createDataFrame(rows, CANDIDATE)).orderBy("kind").collect()]
    assert got[0][:3] == ["kind: no_cycle", "scope: [a/**]", "severity: error"] and got[1][2] == "target: [b/**]" and "prevalence: 0.1250" in got[1]

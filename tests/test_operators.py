import json

import pytest
from pyspark.sql import functions as F

from stratagraph.functions.globs import glob_regex, matches
from stratagraph.functions.paths import cleaned, directory, normalised, package_id, suffix
from stratagraph.operators import aliases, constructions, graph, languages, mining, policy, report, resolve
from stratagraph.operators.policy import Rule

ENTRY = "repo_id string, path string, text string"
IMPORTS = "repo_id string, source_file string, raw_import string, resolved_path string, is_package boolean, line int, column int, kind string"


def imports(spark, rows):
    return spark.createDataFrame([("r", s, raw, res, pkg, 1, 1, "import") for s, raw, res, pkg in rows], IMPORTS)


def files(spark, paths):
    return spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")


@pytest.mark.parametrize(
    ("pattern", "path", "expected"),
    [
        ("src/**", "src/a/b.ts", True),
        ("src/**", "src", True),
        ("src/*.ts", "src/a/b.ts", False),
        ("**/test/**", "a/test/b/c.ts", True),
        ("src\\**", "src/a.ts", True),
        ("", "a", False),
        ("src/[a", "src/a", False),
        ("src/{a,b}/*.ts", "src/b/x.ts", True),
        ("src/?.ts", "src/ab.ts", False),
        ("./**", "x/y", True),
    ],
)
def test_globs(pattern, path, expected):
    assert matches(pattern, path) is expected


def test_malformed_glob_has_no_regex():
    assert glob_regex("a/{b") is None and glob_regex(" ") is None


def test_path_columns(spark):
    rows = [("a/./b/../c.d.ts",), ("a\\b",), ("../x",), ("/../x",), ("",), ("a//b/",)]
    got = spark.createDataFrame(rows, "p string").select(normalised("p"), directory(normalised("p")), suffix("p")).collect()
    assert [r[0] for r in got] == ["a/c.d.ts", "a/b", "../x", "/x", ".", "a/b"]
    assert got[0][1] == "a" and got[0][2] == ".d.ts"
    every = [*rows, ("a/b.ts",), ("@s/p",), ("./x",), ("a/./b",), ("a/.b/c",), ("x/..",), ("..",)]
    assert spark.createDataFrame(every, "p string").where(cleaned("p") != normalised("p")).count() == 0


@pytest.mark.parametrize(("raw", "expected"), [("react", "react"), ("react/jsx", "react"), ("@a/b/c", "@a/b"), ("@a", "@a"), ("node:fs", "node:fs"), ("./x", ""), ("/x", ""), (" lodash?x ", "lodash"), ("a\\b", "a"), ("", "")])
def test_package_ids(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "p string").select(package_id("p")).first()[0] == expected


def test_graph_counts_distinct_files(spark):
    i = imports(spark, [("a/x.ts", "../b/y", "b/y.ts", False), ("a/x.ts", "../b/z", "b/z.ts", False), ("a/w.ts", "../b/y", "b/y.ts", False), ("a/x.ts", "./w", "a/w.ts", False), ("a/x.ts", "react", None, True), ("a/x.ts", "./gone", None, False)])
    assert [tuple(r) for r in graph.edges(i).collect()] == [("r", "a", "b", 2)]
    assert [tuple(r) for r in graph.package_edges(i).collect()] == [("r", "a", "react", 1)]
    assert graph.file_edges(i).count() == 4


def test_rules_in_one_scan(spark):
    f = files(spark, ["domain/user.ts", "domain/User.ts", "infra/log.ts"])
    i = imports(spark, [("domain/user.ts", "../infra/log", "infra/log.ts", False), ("domain/user.ts", "axios/x", None, True)])
    rules = [Rule("A", "no_import", "error", ["domain/**"], ["infra/**"]), Rule("B", "no_package", "warning", ["domain/**"], ["axios"]), Rule("C", "file_pattern", "warning", ["domain/**"], ["^[a-z]+[.]ts$"]), Rule("D", "no_import", "error", ["domain/**"], ["infra/**"], ["infra/log.ts"])]
    found = policy.ordered(policy.evaluate(rules, f, i))
    assert [(r.rule_id, r.file_path) for r in found.collect()] == [("A", "domain/user.ts"), ("B", "domain/user.ts"), ("C", "domain/User.ts")]
    assert policy.exit_code(found) == 1 and policy.exit_code(found.where("severity = 'warning'")) == 0
    assert policy.exit_code(found, parse_errors=1, parse_policy="error") == 2


def test_cycles(spark):
    i = imports(spark, [("a/x.ts", "", "b/x.ts", False), ("b/x.ts", "", "c/x.ts", False), ("c/x.ts", "", "a/x.ts", False), ("d/x.ts", "", "a/x.ts", False)])
    assert [r.chain for r in graph.cycles(graph.edges(i)).collect()] == ["a -> b -> c -> a"]
    found = policy.evaluate([Rule("N", "no_cycle", "error", ["**"])], files(spark, ["a/x.ts"]), i).collect()
    assert [(r.file_path, r.details) for r in found] == [("a", "a -> b -> c -> a")]
    rule = mining.cycle_rules(graph.nodes(files(spark, ["a/x.ts", "b/x.ts", "c/x.ts"])), graph.edges(i), 3).first()
    assert (rule.support, rule.violations, rule.evidence) == (3, 3, "cycle component (3 subtrees): a <-> b <-> c")


def test_resolution(spark):
    rows = [("src/a.ts", "./b", None, None), ("src/a.ts", "./c", None, None), ("src/a.ts", "./b.js", None, None), ("src/a.ts", "@/infra/auth", None, None), ("src/a.ts", "react", None, None), ("src/a.ts", "/src/b", None, None), ("x/a.php", "App\\Infra\\Db", None, None), ("x/a.php", "Foo", None, None), ("src/a.ts", "./user.service", None, None)]
    entries = files(spark, ["src/a.ts", "src/b.ts", "src/c/index.ts", "src/infra/auth.ts", "app/Infra/Db.php", "src/user.service.ts"])
    got = {(r.raw_import): (r.resolved_path, r.is_package) for r in resolve.resolve_imports(imports(spark, rows), entries, aliases.aliases(spark.createDataFrame([], ENTRY), spark.createDataFrame([("r", "@/*", "src/*"), ("r", "App\\*", "app/*")], "repo_id string, alias string, target string"))).collect()}
    assert got == {"./b": ("src/b.ts", False), "./c": ("src/c/index.ts", False), "./b.js": (None, False), "@/infra/auth": ("src/infra/auth.ts", False), "react": (None, True), "/src/b": ("src/b.ts", False), "App\\Infra\\Db": ("app/Infra/Db.php", False), "Foo": (None, False), "./user.service": ("src/user.service.ts", False)}


def _plain_resolution(source, raw, entries):
    """What an import without aliases resolves to, tried one path after the other."""
    import posixpath

    exts, raw = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".php"), raw.strip(" ")
    php = source.lower().endswith((".php", ".phtml"))
    clean = lambda p: posixpath.normpath(p.replace("\\", "/")) if p else "."

    def found(path):
        tried = [path] if path.endswith(exts) else [path, *(path + e for e in exts), *(path + "/index" + e for e in exts)]
        return next((p for p in tried if p in entries), None)

    beside, php_file = clean((posixpath.dirname(source) or ".") + "/" + raw), php and "/" in raw and raw.lower().endswith(".php") and not raw.startswith("@")
    if raw.startswith("."):
        return found(beside), False
    if raw.startswith("/"):
        return found(clean(raw.lstrip("/"))), False
    if php and raw.startswith("@"):
        return None, False
    if php_file:
        return found(beside) or found(clean(raw)), False
    if php and raw and all(c.isascii() and (c.isalnum() or c == "_") for c in raw):
        return None, False
    if "\\" in raw:
        path = raw.replace("\\", "/").lstrip("/")
        hit, top = found(clean(path)), path.split("/")[0]
        return hit, hit is None and not (top != "vendor" and any(e.startswith(top + "/") for e in entries))
    return None, True


def test_resolution_equals_a_plain_reading(spark):
    """Entries met by their stems, and by place: what lies beside a file, found by groups, and what holds for every file of its kind."""
    import random

    r = random.Random(7)
    ends = ["", ".ts", ".tsx", ".js", ".php", ".PHP", ".js.ts", "/index.ts", "/index.php", "/index", ".service"]
    name = lambda: "/".join(r.choice("abc") for _ in range(r.randrange(1, 4)))
    held = sorted({name() + r.choice(ends) for _ in range(120)} | {"vendor/a/b.php", "a/b", "a/b.ts", "a/b/index.ts"})
    before = ["./", "../", "../../", "./../", "/", "//", "", "@a/", ".", "vendor\\", "\\a\\", "a\\b\\", " "]
    rows = sorted({(name() + r.choice([".ts", ".php", ".PHTML", ""]), r.choice(before) + name() + r.choice([*ends, "/", "/.", "\\c"])) for _ in range(3000)} | {("x.php", "Bare_1"), ("x.ts", "Bare_1"), ("x.php", "a\\gone"), ("x.php", "q\\gone")})
    i = spark.createDataFrame([("r", s, raw, s.rsplit("/", 1)[0]) for s, raw in rows], "repo_id string, source_file string, raw_import string, g string")
    e = files(spark, held)
    got = {(x.source_file, x.raw_import): (x.resolved_path, x.is_package) for x in resolve.resolve_imports(i, e).collect()}
    want = {(s, raw): _plain_resolution(s, raw, set(held)) for s, raw in rows}
    assert got == want and sum(x[0] is not None for x in want.values()) > 300
    rooted = resolve.named(resolve.resolve_imports(i, e, by_place=False)).join(resolve.found_beside(i, e, "g"), "g", "left")
    path = F.coalesce(F.when(F.col("near"), F.element_at("held", resolve.beside(directory("source_file"), F.col("raw")))), "resolved_path")
    assert {(x.source_file, x.raw_import): (x.p, x.is_package) for x in rooted.select("*", path.alias("p")).collect()} == want


def _written_by_shuffles(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_forms_are_dealt_as_keys(spark):
    """Shuffles hold the keys of purchases, not the imports and paths to try that follow from them; those took 16 times the tables."""
    import os

    from stratagraph.plans import registry

    d = "/root/testdata/sf0.01"
    read = sum(os.path.getsize(f"{d}/{t}.parquet") for t in ("customer", "supplier", "orders", "lineitem"))
    before = _written_by_shuffles(spark)
    registry.QUERIES["resolve_forms"](spark, d).write.format("noop").mode("overwrite").save()
    assert 0 < _written_by_shuffles(spark) - before < 4 * read


def test_forms_of_repeated_and_oddly_named_rows(spark, tmp_path):
    """Rows that repeat, a supplier of two nations, keys that are null, and a nation whose name reads like a supplier's file."""
    import duckdb

    from stratagraph.plans import registry

    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    odd = {
        "region": "SELECT * FROM t UNION ALL SELECT * FROM t WHERE r_regionkey = 1", "customer": "SELECT * FROM t UNION ALL SELECT * FROM t WHERE c_custkey % 5 = 0 UNION ALL SELECT * REPLACE ((c_nationkey + 1) % 25 AS c_nationkey) FROM t WHERE c_custkey % 7 = 0",
        "nation": "SELECT * REPLACE (CASE WHEN n_nationkey IN ({}) THEN 'my supp7 ' || n_nationkey ELSE n_name END AS n_name) FROM t", "supplier": "SELECT * FROM t UNION ALL SELECT * REPLACE ((s_nationkey + 3) % 25 AS s_nationkey) FROM t WHERE s_suppkey % 2 = 0 UNION ALL SELECT * FROM t",
        "orders": "SELECT * REPLACE (nullif(o_custkey, 4) AS o_custkey) FROM t", "lineitem": "SELECT * REPLACE (nullif(l_suppkey, 3) AS l_suppkey) FROM t UNION ALL SELECT * FROM t WHERE l_orderkey % 3 = 0",
    }
    for nations in ("-1", ", ".join(map(str, range(0, 25, 2)))):
        at = tmp_path / nations[:2]
        at.mkdir()
        for name, sql in odd.items():
            con.execute(f"COPY ({sql.format(nations).replace('FROM t', f'''FROM '{d}/{name}.parquet' ''')}) TO '{at}/{name}.parquet'")
            con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
        got = sorted(map(repr, map(tuple, registry.QUERIES["resolve_forms"](spark, str(at)).collect())))
        want = sorted(map(repr, con.execute(f"SELECT source_file, raw_import, resolved_path, is_package FROM ({registry.SQL['resolve_forms']})").fetchall()))
        assert len(want) > 1000 and got == want


def test_constructions(spark):
    f = files(spark, ["a.ts", "s.ts"])
    news = spark.createDataFrame([("r", "a.ts", n, k, 1, i) for k, (n, i) in enumerate([("Local", True), ("Svc", True), ("Far", True), ("fn", True), ("Date", True), ("x", False)])], "repo_id string, file string, class_name string, line int, column int, is_identifier boolean")
    bindings = spark.createDataFrame([("r", "a.ts", "Svc", "UserService", "s.ts"), ("r", "a.ts", "Far", "X", "gone.ts"), ("r", "a.ts", "fn", "default", "s.ts")], "repo_id string, file string, local string, imported string, resolved_path string")
    classes = spark.createDataFrame([("r", "a.ts", "Local"), ("r", "s.ts", "UserService")], "repo_id string, file string, name string")
    exports = spark.createDataFrame([("r", "s.ts", "UserService", "UserService")], "repo_id string, file string, export_name string, local_class string")
    c = constructions.resolve_constructions(f, news, bindings, classes, exports, ["s.ts"])
    got = {r.class_name: (r.resolved_class, r.is_service, r.unresolved_reason) for r in c.collect()}
    assert got == {"Local": ("Local", False, None), "Svc": ("UserService", True, None), "Far": (None, False, "import_target_not_parsed"), "fn": (None, False, "default_export_not_class"), "Date": (None, False, "symbol_not_resolved"), "x": (None, False, "dynamic_constructor")}
    m = constructions.construction_match(c, f, ["**"], ["boot/**"]).first()
    assert (m.eligible_files, m.violating_files, m.resolved_count, m.unresolved_count, m.sample_locations) == (1, 1, 2, 4, ["a.ts:1"])


def random_repositories(spark, count=3, seed=5):
    """Files and imports of repositories with directories that import one another and packages, some of them of odd names."""
    import random

    r = random.Random(seed)
    file_rows, rows = [], []
    for repo in (f"r{k}" for k in range(count)):
        paths = [f"top{k % 2}/d{k % 11}/f{k}.ts" for k in range(90)] + [f"test/f{k}.ts" for k in range(6)] + [f"lone/f{k}.ts" for k in range(7)]
        file_rows += [(repo, p) for p in paths]
        for p in paths[:96]:
            for t in {r.choice(paths[:70]) for _ in range(r.randrange(3))}:
                rows.append((repo, p, "./x", t, False, 1, 1, "import"))
            rows += [(repo, p, r.choice([f"pkg{r.randrange(12)}/y", "@a/b/c", "Odd", "node:fs"]), None, True, 1, 1, "import") for _ in range(r.randrange(3))]
    f = spark.createDataFrame(file_rows, "repo_id string, path string")
    return f, spark.createDataFrame(rows, "repo_id string, source_file string, raw_import string, resolved_path string, is_package boolean, line int, column int, kind string")


def mining_inputs(f, i):
    nodes, edges, packages = graph.nodes(f), graph.edges(i), graph.package_edges(i)
    activity = graph.source_activity(graph.file_edges(i), packages)
    return nodes, activity, (("no_import", edges, "dst", nodes.select("repo_id", F.col("subtree").alias("target"))), ("no_package", packages, "pkg", packages.select("repo_id", F.col("pkg").alias("target")).distinct()))


def sequential(pairs, support):
    """The pairs that are kept, and those that caps drop with their reason, one after the other in order of scope and target."""
    from collections import Counter

    cap, kept, dropped = mining.limits(support), [], {}
    by_scope, by_target = Counter(), Counter()
    for x in sorted(pairs, key=lambda x: (x.repo_id, x.scope, x.target)):
        if x.violations:
            kept.append(x)
        elif by_scope[x.repo_id, x.scope] >= cap["per_scope"]:
            dropped[x.repo_id, x.scope, x.target] = "zero_source_cap"
        elif by_target[x.repo_id, x.target] >= cap["per_target"]:
            dropped[x.repo_id, x.scope, x.target] = "zero_target_cap"
        else:
            by_scope[x.repo_id, x.scope] += 1
            by_target[x.repo_id, x.target] += 1
            kept.append(x)
    return kept, dropped


@pytest.mark.parametrize("support", [3, 6])
def test_greedy_caps_and_counters_equal_plain_ones(spark, support, monkeypatch):
    monkeypatch.setattr(mining, "limits", lambda n: {"imports": 1, "packages": 1, "per_scope": 3, "per_target": 2})
    f, i = random_repositories(spark)
    nodes, activity, kinds = mining_inputs(f, i)
    for kind, e, target, targets in kinds:
        every = mining.pairs(kind, nodes, e, target, targets, activity, support, 0.3)
        kept, dropped = sequential(every.where("drop_reason is null").collect(), support)
        accepted = mining.greedy_accepted(mining.sides(kind, nodes, e, target, activity, support, 0.3), support)
        assert sorted(map(tuple, accepted.collect())) == sorted((x.repo_id, x.scope, x.target) for x in kept if not x.violations)
        capped = mining.greedy_caps(every, accepted, support).where("drop_reason like '%_cap'")
        assert {(x.repo_id, x.scope, x.target): x.drop_reason for x in capped.collect()} == dropped
        counts = mining.drop_counts(kind, nodes, e, target, targets, activity, support, 0.3).collect()
        assert sorted(map(tuple, counts)) == sorted(map(tuple, mining.drop_stats(every).collect()))
        assert support == 6 or len({x.reason for x in counts}) >= 3 and set(dropped.values()) == {"zero_source_cap", "zero_target_cap"}


def plain_candidates(kind, kept):
    """Candidates of kept pairs, siblings joined, as dictionaries."""
    sure = lambda p, n: "HIGH" if p <= 0.01 and n >= 50 else "MEDIUM" if p <= 0.02 and n >= 20 else "LOW"
    made = lambda x, scope, target, support, bad, evidence: {"repo_id": x.repo_id, "kind": kind, "scope": scope + "/**", "target": target + "/**" * (kind == "no_import"), "severity": "warning", "support": support, "violations": bad, "prevalence": bad / support, "confidence": sure(bad / support, support), "evidence": evidence}
    out, siblings = [], {}
    for x in kept:
        parent = x.scope.rpartition("/")[0]
        if x.violations or not parent:
            out.append(made(x, x.scope, x.target, x.support, x.violations, f"{x.violations}/{x.support} files in {x.scope} import {x.target}"))
        else:
            siblings.setdefault((x.repo_id, parent, x.target), []).append(x)
    for (_, parent, target), group in siblings.items():
        n, x = sum(x.support for x in group), group[0]
        shown = target + "/**" * (kind == "no_import")
        out.append(made(x, parent, target, n, 0, f"0/{n} files across {len(group)} sibling scopes under {parent} import {shown}") if len(group) > 1 else made(x, x.scope, target, n, 0, f"0/{n} files in {x.scope} import {target}"))
    return out


@pytest.mark.parametrize("most", [200, 12])
def test_propose_equals_a_plain_reading(spark, most):
    f, i = random_repositories(spark, 2, 8)
    nodes, activity, kinds = mining_inputs(f, i)
    want = []
    for kind, e, target, targets in kinds:
        kept, _ = sequential(mining.pairs(kind, nodes, e, target, targets, activity, 5, 0.3).where("drop_reason is null").collect(), 5)
        for repo in ("r0", "r1"):
            order = lambda c: (-{"HIGH": 3, "MEDIUM": 2, "LOW": 1}[c["confidence"]], -c["support"], c["prevalence"], c["violations"], c["scope"], c["target"])
            c = sorted((x for x in plain_candidates(kind, kept) if x["repo_id"] == repo), key=order)
            if len(c) > most:
                bad, rest = [x for x in c if x["violations"]][:most], [x for x in c if not x["violations"]]
                n_bad = sum(x["violations"] > 0 for x in c)
                share = lambda part: most // part if most // part >= 20 else most
                c = bad + rest[: max(0, min(min(share(2), share(3)) if not n_bad else share(2), most - n_bad))]
            want += c
    got = [x.asDict() for x in mining.propose(f, i, 5, 0.3, most).where("kind in ('no_import', 'no_package')").collect()]
    key = lambda x: sorted((k, str(v)) for k, v in x.items())
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 20


def test_sibling_scopes_and_cap(spark):
    schema = "repo_id string, kind string, scope string, target string, severity string, support long, violations long, prevalence double, confidence string, evidence string"
    c = spark.createDataFrame([("r", "no_import", f"src/{d}/**", "infra/**", "warning", 30, 0, 0.0, "MEDIUM", "") for d in "abc"] + [("r", "no_import", "lib/**", "infra/**", "warning", 30, 1, 0.01, "MEDIUM", "")], schema)
    got = sorted((r.scope, r.support, r.confidence) for r in mining.sibling_scopes(c).collect())
    assert got == [("lib/**", 30, "MEDIUM"), ("src/**", 90, "HIGH")]
    assert mining.ranked_cap(c, 2).where("violations > 0").count() == 1


def test_file_patterns(spark):
    f = files(spark, [f"src/s/f{k}.service.ts" for k in range(9)] + ["src/s/x.ts"])
    r = mining.file_patterns(f, 5).first()
    assert (r.scope, r.target, r.support, r.violations) == ("src/s/**", "^.*\\.service\\.ts$", 10, 1)


def test_registered_queries_match_sql(spark):
    import duckdb

    from stratagraph.plans import registry

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name in ("subtree_edges", "findings_all_rules", "mine_file_pattern", "cycle_components", "resolve_imports", "extract_imports", "extract_constructions", "findings_text", "resolve_aliases", "resolve_forms", "languages", "rule_no_cycle", "construction_boundary", "sarif_results", "extract_php_imports"):
        a, b = registry.QUERIES[name](spark, d).toPandas(), con.execute(registry.SQL[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        rows = lambda x, cols=cols: sorted(map(str, x[cols].astype(object).where(x[cols].notna(), None).values.tolist()))
        assert rows(a) == rows(b), name


def test_normalised_graph_sums(spark):
    e = spark.createDataFrame([("r", "a/[x]", "b", 2), ("r", "a/[y]", "b", 3), ("r", "a/[x]", "a/[y]", 1)], "repo_id string, src string, dst string, n_files long")
    got = graph.normalised_graph(e, lambda c: F.regexp_replace(c, r"\[[^/]*\]", "[param]")).collect()
    assert [tuple(r) for r in got] == [("r", "a/[param]", "b", 5)]


@pytest.mark.parametrize(("pattern", "expected"), [("^a$", "^a\\z"), ("a\\$b$", "a\\$b\\z"), ("[$]$", "[$]\\z"), ("(?P<n>x)", "(?<n>x)"), ("[]$]$", "[\\]$]\\z"), ("\\Q$\\E$", "\\Q$\\E\\z")])
def test_regex_dialect(pattern, expected):
    assert policy.regex_dialect(pattern) == expected


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", "a++", "(a)\\1"])
def test_patterns_beyond_the_dialect(pattern):
    with pytest.raises(ValueError):
        policy.regex_dialect(pattern)


def test_messages_and_text(spark):
    f = files(spark, ["domain/User.ts"])
    i = imports(spark, [("domain/user.ts", "../infra/log", "infra/log.ts", False), ("domain/user.ts", "axios/x", None, True), ("infra/a.ts", "", "domain/b.ts", False)])
    rules = [Rule("A", "no_import", "error", ["domain/**"], ["infra/**"]), Rule("B", "no_package", "warning", ["domain/**"], ["axios"]), Rule("C", "file_pattern", "warning", ["domain/**"], ["^[a-z]+[.]ts$"]), Rule("D", "no_cycle", "error", ["**"]), Rule("E", "no_package", "warning", ["domain/**"], ["axios"], message="own")]
    found = policy.evaluate(rules, f, i)
    assert {r.rule_id: r.message for r in found.collect()} == {"A": "domain/user.ts imports infra/log.ts", "B": "domain/user.ts imports package axios/x", "C": "domain/User.ts does not match required file pattern", "D": "dependency cycle detected: domain -> infra -> domain", "E": "own"}
    text = {r.heading: r.text for r in report.text_findings(found).collect()}
    assert text["A (error)"] == "  - domain/user.ts:1:1 domain/user.ts imports infra/log.ts (import: ../infra/log)"
    assert text["D (error)"] == "  - domain:1:1 dependency cycle detected: domain -> infra -> domain [domain -> infra -> domain]"
    s = policy.summary(found, f, i)
    assert tuple(s.first()) == ("r", 1, 3, 5, 2, 3, 0, 0)
    assert report.text_summary(s).first().text == "Summary: files=1 imports=3 findings=5 (error=2 warning=3) parse_errors=0 files_skipped=0"


def test_components_equal_brute_force(spark):
    import random

    r = random.Random(4)
    rows = []
    for repo in range(6):
        n = 14
        rows += [(f"r{repo}", f"n{r.randrange(n):02d}", f"n{r.randrange(n):02d}", 1) for _ in range(16 + 2 * repo)]
    rows += [("path", f"p{k:02d}", f"p{k + 1:02d}", 1) for k in range(6)] + [("self", "a", "a", 1)]
    want = set()
    for repo in {x[0] for x in rows}:
        edges = {(a, b) for q, a, b, _ in rows if q == repo and a != b}
        nodes = {x for e in edges for x in e}
        reach = {a: {a} for a in nodes}
        for _ in nodes:
            for a, b in edges:
                for x in nodes:
                    if a in reach[x]:
                        reach[x].add(b)
        for a in nodes:
            ring = {b for b in nodes if b in reach[a] and a in reach[b]}
            if len(ring) > 1:
                want.add((repo, a, min(ring)))
    e = spark.createDataFrame(rows, "repo_id string, src string, dst string, n_files long")
    assert {tuple(x) for x in graph.components(e).collect()} == want and graph.components(e.limit(0)).count() == 0


def test_long_rings_and_paths_take_few_rounds(spark, monkeypatch):
    written = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or real(df, name))
    n = 4096
    ring = spark.range(n).selectExpr("'r' AS repo_id", "concat('n', id) AS src", f"concat('n', (id + 1) % {n}) AS dst", "1L AS n_files")
    assert [tuple(x) for x in graph.components(ring).groupBy("component").count().collect()] == [("n0", n)]
    assert len(written) <= 20
    written.clear()
    path = spark.range(n).selectExpr("'p' AS repo_id", "concat('n', id) AS src", "concat('n', id + 1) AS dst", "1L AS n_files")
    assert graph.components(path).count() == 0 and len(written) <= 20


def test_components_of_runs_that_meet(spark):
    """Rings that share nodes, runs between and beside them, and a ring on a ring's run, against a plain search."""
    import random

    r = random.Random(11)
    rows = []
    for repo in range(8):
        edges = [(r.randrange(6), r.randrange(6)) for _ in range(7)]
        for k, (a, b) in enumerate(edges):  # each edge becomes a run of up to four nodes
            run = [f"h{a}", *(f"{'abz'[k % 3]}{repo}{k}{j}" for j in range(r.randrange(5))), f"h{b}"]
            rows += [(f"r{repo}", x, y, 1) for x, y in zip(run, run[1:])]
    want = set()
    for repo in {x[0] for x in rows}:
        follow: dict = {}
        for q, a, b, _ in rows:
            if q == repo and a != b:
                follow.setdefault(a, set()).add(b)
        reach = {}
        for a in follow:
            seen, todo = set(), list(follow[a])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += follow.get(x, ())
            reach[a] = seen
        want |= {(repo, a, min(b for b in reach[a] if a in reach.get(b, ()))) for a in reach if a in reach[a]}
    e = spark.createDataFrame(rows, "repo_id string, src string, dst string, n_files long")
    assert len({x[2] for x in want}) > 3
    assert {tuple(x) for x in graph.components(e).collect()} == want


def test_chains_equal_a_plain_search(spark):
    import random

    def plain(follow):
        out, done = [], set()

        def visit(node, path):
            done.add(node)
            for x in sorted(follow.get(node, ())):
                if x in path:
                    out.append(" -> ".join([*path[path.index(x) :], x]))
                elif x not in done:
                    visit(x, [*path, x])

        for node in sorted(follow):
            if node not in done:
                visit(node, [node])
        return sorted(out)

    r = random.Random(5)
    rows = [(f"r{q}", f"n{r.randrange(9)}", f"n{r.randrange(9)}", 1) for q in range(6) for _ in range(22)]
    e = spark.createDataFrame([x for x in rows if x[1] != x[2]], "repo_id string, src string, dst string, n_files long")
    of = {(x.repo_id, x.node): x.component for x in graph.components(e).collect()}
    want = []
    for key in sorted({(q, c) for (q, _), c in of.items()}):
        inside = {n for (q, n), c in of.items() if (q, c) == key}
        follow: dict = {}
        for q, a, b, _ in rows:
            if q == key[0] and a in inside and b in inside and a != b:
                follow.setdefault(a, set()).add(b)
        want += [(*key, c) for c in plain(follow)]
    assert len(want) > 20
    assert sorted((x.repo_id, x.component, x.chain) for x in graph.cycles(e).collect()) == sorted(want)


def test_a_component_of_a_million_edges_in_bounded_memory():
    """In a process of its own: rings of three and two along a path of 333,335 nodes, in batches of 10,000."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np, pyarrow as pa
from stratagraph.operators.graph import chains
n = 333_335
k = np.arange(n)
src, dst = np.concatenate([k[:-1], k[1:], k[2:]]), np.concatenate([k[1:], k[:-1], k[:-2]])
o = np.lexsort((dst, src))
name = lambda xs: pa.array([f"src/packages/directory{x:09d}" for x in xs])
def batches():
    for a in range(0, len(o), 10_000):
        s, d = name(src[o[a : a + 10_000]]), name(dst[o[a : a + 10_000]])
        yield pa.RecordBatch.from_arrays([pa.array(["r"] * len(s)), pa.array(["c"] * len(s)), s, d], ["repo_id", "component", "src", "dst"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = sum(b.num_rows for b in chains(batches()))
print(len(o), rows, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    edges, rows, megabytes = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert edges > 1_000_000 and rows == edges - 333_334 and megabytes < 1024


def test_open_pairs_are_those_not_dropped(spark):
    import random

    r = random.Random(5)
    f = files(spark, [f"d{k % 9}/f{k}.ts" for k in range(60)] + [f"test/f{k}.ts" for k in range(6)])
    rows = [(f"d{k % 9}/f{k}.ts", f"d{t}/x", f"d{t}/f{t}.ts", False) for k in range(60) for t in {r.randrange(6) for _ in range(2)}]
    rows += [(f"d{k % 9}/f{k}.ts", f"pkg{r.randrange(4)}/y", None, True) for k in range(60)] + [("d1/f1.ts", "Odd", None, True)] * 3
    i = imports(spark, rows)
    nodes, edges, packages = graph.nodes(f), graph.edges(i), graph.package_edges(i)
    activity = graph.source_activity(graph.file_edges(i), packages)
    for kind, e, target, targets in (("no_import", edges, "dst", nodes.select("repo_id", F.col("subtree").alias("target"))), ("no_package", packages, "pkg", packages.select("repo_id", F.col("pkg").alias("target")).distinct())):
        want = mining.pairs(kind, nodes, e, target, targets, activity, 5, 0.3).where("drop_reason is null").collect()
        got = mining.open_pairs(kind, nodes, e, target, activity, 5, 0.3).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and got
    every = mining.propose(f, i, 5, 0.3).collect()
    assert {x.kind for x in every} >= {"no_import", "file_pattern", "no_cycle"} and len(set(every)) == len(every)


def test_aliases_of_manifests(spark):
    tsconfig = """{
      // base
      "extends": "./x//y", /* "paths": {} */
      "compilerOptions": { "baseUrl": "./src", "paths": { "@/*": ["app/*", "lib/*",], "one": ["app/one.ts"], }, },
    }"""
    composer = '{"autoload": {"psr-4": {"App\\\\": "lib/", "Top\\\\": "./"}}, "autoload-dev": {"psr-4": {"App\\\\Tests\\\\": ["t/", "u"]}}}'
    entries = spark.createDataFrame([("a", "tsconfig.json", tsconfig), ("a", "jsconfig.json", "{}"), ("b", "composer.json", composer), ("c", "tsconfig.json", "no json"), ("d", "jsconfig.json", '{"compilerOptions": {"paths": {"x": ["y"]}}}'), ("e", "tsconfig.json", None)], ENTRY)
    got = sorted((r.repo_id, r.alias, r.target) for r in aliases.aliases(entries).collect())
    assert got == [("a", "@/*", "src/app/*"), ("a", "@/*", "src/lib/*"), ("a", "one", "src/app/one.ts"), ("b", "App/*", "lib/*"), ("b", "App/Tests/*", "t/*"), ("b", "App/Tests/*", "u/*"), ("b", "Top/*", "*"), ("d", "x", "y")]
    held = [("a", "src/lib/q.ts", None), ("a", "src/app/one.ts", None), ("b", "u/T.php", None), ("b", "lib/K.php", None), ("b", "src/lib/q.ts", None)]
    rows = [("a", "m.ts", "@/q"), ("a", "m.ts", "one"), ("a", "m.ts", "one/two"), ("b", "m.php", "App\\Tests\\T"), ("b", "m.php", "App\\K"), ("b", "m.ts", "@/q")]
    i = spark.createDataFrame(rows, "repo_id string, source_file string, raw_import string")
    found = {(r.repo_id, r.raw_import): (r.resolved_path, r.is_package) for r in resolve.resolve_imports(i, spark.createDataFrame(held, ENTRY), aliases.aliases(entries)).collect()}
    assert found == {("a", "@/q"): ("src/lib/q.ts", False), ("a", "one"): ("src/app/one.ts", False), ("a", "one/two"): (None, True), ("b", "App\\Tests\\T"): ("u/T.php", False), ("b", "App\\K"): ("lib/K.php", False), ("b", "@/q"): (None, True)}


def test_plain_json_keeps_strings_and_takes_long_ones(spark):
    """Comments and commas go, strings stay; strings and comments of a megabyte do not exhaust the stack."""
    cases = [('{"a": 1} // comment', '{"a": 1} '), ('{"a": /* block */ 1}', '{"a":  1}'), ('{"url": "http://example.com/api//v1"}', None), ('{"a": "hello /* world */"}', None), ('{"a": "\\"//not a comment\\""}', None), ('{"a": [1, 2,], }', '{"a": [1, 2] }'), ('{"a": ",]"}', None), ('{"a": "open', None)]
    long = "x\\n" * 400000
    cases += [(f'{{"a": "{long}", /* {long} */ "b": 1,}} // {long}', f'{{"a": "{long}",  "b": 1}} ')]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.j for r in df.select("k", aliases.plain_json(F.col("t")).alias("j")).collect()}
    assert got == {k: b if b is not None else a for k, (a, b) in enumerate(cases)}


def test_quoted_escapes_control_characters(spark):
    df = spark.createDataFrame([("plain é",), ('a"b\\c\n\t\r\x00\x1f\x7f\v',)], "t string")
    assert [r.q for r in df.select(report.quoted(F.col("t")).alias("q")).collect()] == ['"plain é"', '"a\\"b\\\\c\\n\\t\\r\\x00\\x1f\\x7f\\v"']


def test_languages(spark):
    f = spark.createDataFrame([("a", "x/tsconfig.json"), ("a", "b.php"), ("b", "x.php"), ("c", "readme.md"), ("c", None)], "repo_id string, path string")
    got = {r.repo_id: (r.language, r.reason) for r in languages.languages(f).collect()}
    assert got == {"a": ("javascript", "auto_ambiguous_first_selected"), "b": ("php", "auto_detected"), "c": ("javascript", "auto_none_fallback_default")}
    assert {r.reason for r in languages.languages(f, "PHP ").collect()} == {"explicit"} and languages.languages(f, "go").first().language is None


def test_construction_boundary(spark):
    from stratagraph.operators import catalog

    f = files(spark, ["src/feature/controller.ts", "src/services/user.ts", "src/di/c.ts", "src/main/m.ts"])
    made = spark.createDataFrame([("r", "src/feature/controller.ts", "UserService", 4, True, True, None), ("r", "src/di/c.ts", "UserService", 2, True, True, None)], "repo_id string, file string, class_name string, line int, is_resolved boolean, is_service boolean, unresolved_reason string")
    m = catalog.construction_matches(made, f).first()
    assert (round(m.score, 4), m.confidence, m.proposed_rule_id) == (0.77, "MEDIUM", "AG-CAT-SERVICES-VIA-COMPOSITION-ROOT-e8d6300f")
    assert m.evidence == "1/1 eligible files instantiate service classes (1 events, resolved=1 unresolved=0); examples: src/feature/controller.ts:4:new UserService"
    f = files(spark, [f"src/feature/f{k}.ts" for k in range(10)] + ["src/services/user.ts"])
    rows = [("r", "src/feature/f0.ts", "UserService", 4, True, True, None)] + [("r", f"src/feature/f{k}.ts", "Plain", 1, True, False, None) for k in (1, 2)] + [("r", f"src/feature/f{k}.ts", "Date", 1, False, False, "symbol_not_resolved") for k in (3, 4, 5, 6)]
    m = catalog.construction_matches(spark.createDataFrame(rows, made.schema), f, show_low=True).first()
    assert (round(m.score, 2), m.confidence, m.violating_files, m.eligible_files, m.scoped_files) == (0.49, "LOW", 1, 7, 11)
    assert catalog.construction_matches(spark.createDataFrame(rows, made.schema), f).count() == 0


def test_propose_by_each_repositorys_profile(spark):
    """Directories of one name under a profile are mined as one; a repository without a profile keeps its own."""
    paths = [f"app/[id{k}]/{name}{k}.ts" for k in range(6) for name in "ab"]
    f = spark.createDataFrame([(repo, p) for repo in ("next", "plain") for p in [*paths, "lib/x.ts", "other/y.ts"]], "repo_id string, path string")
    rows = [(repo, p, "axios", None, True, 1, 1, "import") for repo in ("next", "plain") for p in paths] + [(repo, p, "./x", "lib/x.ts", False, 1, 1, "import") for repo in ("next", "plain") for p in paths[:1]]
    i = spark.createDataFrame(rows, IMPORTS)
    frameworks = spark.createDataFrame([("next", "nextjs"), ("plain", "generic")], "repo_id string, framework string")
    got = {(x.repo_id, x.scope, x.target): (x.support, x.violations) for x in mining.propose(f, i, 10, 0.5, frameworks=frameworks).where("kind = 'no_import'").collect()}
    assert got == {("next", "app/[param]/**", "lib/**"): (12, 1)}
    assert {x.repo_id for x in mining.propose(f, i, 10, 0.5).where("kind = 'no_import'").collect()} == set()


def test_adopted_rules_and_catalog_matches(spark):
    """A boundary and a construction pattern: their matches as JSON and text, and the configuration that adopts them."""
    from stratagraph.operators import catalog

    schema = "repo_id string, kind string, scope string, target string, severity string, support long, violations long, prevalence double, confidence string, evidence string"
    c = spark.createDataFrame([("r", "no_import", "src/domain/**", "src/infra/**", "warning", 40, 0, 0.0, "MEDIUM", "0/40 files in src/domain import src/infra"), ("r", "no_cycle", "a/**", None, "error", 3, 3, 1.0, "HIGH", "x")], schema)
    f = files(spark, [f"src/feature/f{k}.ts" for k in range(3)] + ["src/services/user.ts"])
    made = spark.createDataFrame([("r", "src/feature/f0.ts", "UserService", 4, True, True, None), ("r", "src/feature/f1.ts", "Date", 1, False, False, "symbol_not_resolved")], "repo_id string, file string, class_name string, line int, is_resolved boolean, is_service boolean, unresolved_reason string")
    m = catalog.all_matches(c, made, f, show_low=True).cache()
    got = {x.catalog_id: json.loads(x.json) for x in report.json_matches(m).collect()}
    assert set(got) == {"CAT-LAYERED-DOMAIN-INFRA", "CAT-SERVICES-VIA-COMPOSITION-ROOT"}
    layered, services = got["CAT-LAYERED-DOMAIN-INFRA"], got["CAT-SERVICES-VIA-COMPOSITION-ROOT"]
    assert layered["proposed_rule"] | {"ID": "", "Message": ""} == {"ID": "", "Kind": "pattern", "Severity": "warning", "Scope": ["src/domain/**"], "Target": ["src/infra/**"], "Except": None, "Template": "dependency_constraint", "Params": {"relation": "imports"}, "Message": ""}
    assert "resolved_count" not in layered and "sample_locations" not in layered and set(layered["score_components"]) == {"structural_fit", "prevalence_support", "naming_fit"}
    assert services["unresolved_reasons"] == [{"reason": "symbol_not_resolved", "count": 1}] and services["sample_locations"] == ["src/feature/f0.ts:4"] and services["proposed_rule"]["Params"] == {"service_name_regex": ".*Service$"}
    text = {x.catalog_id: x.block for x in report.text_matches(m, debug=True).collect()}["CAT-SERVICES-VIA-COMPOSITION-ROOT"]
    assert "resolved_count: 1\nunresolved_count: 1\nresolved_examples: [src/feature/f0.ts:4:new UserService]" in text and text.endswith("unresolved_reasons: [{symbol_not_resolved 1}]")
    rows = report.emitted_config(c, m, "medium", "error").orderBy("part", "id").collect()
    whole = "\n".join(x.yaml for x in rows)
    assert [x.part for x in rows] == [0, 1, 1] + [2] * m.where("confidence <> 'LOW'").count() and whole.startswith("version: 1\nproject:\n  roots: [\".\"]")
    assert '    template: dependency_constraint\n    scope:\n      - "src/domain/**"\n    target:\n      - "src/infra/**"\n    params:\n      relation: "imports"\n    message: "[derived_from_catalog=CAT-LAYERED-DOMAIN-INFRA] ' in whole
    assert "    severity: error\n    scope:\n      - \"a/**\"\n    message" in whole
    strict = report.emitted_config(c, m).where("part = 2").count()
    assert strict == m.where("confidence = 'HIGH'").count()


def test_mined_rules(spark):
    schema = "repo_id string, kind string, scope string, target string, severity string, support long, violations long, prevalence double, confidence string, evidence string"
    c = spark.createDataFrame([("r", "no_cycle", "a/**", None, "error", 3, 3, 1.0, "HIGH", 'x "y"'), ("r", "file_pattern", "b/**", "^.*\\.ts$", "warning", 3, 0, 0.0, "HIGH", "e")], schema)
    got = {r.id: r.yaml for r in report.mined_rules(c, " ERROR").collect()}
    assert got["MINED-001"] == '  - id: MINED-001\n    kind: file_pattern\n    severity: warning\n    scope:\n      - "b/**"\n    target:\n      - "^.*\\\\.ts$"\n    message: "e"'
    assert got["MINED-002"] == '  - id: MINED-002\n    kind: no_cycle\n    severity: error\n    scope:\n      - "a/**"\n    message: "x \\"y\\""'
    assert report.json_candidates(c).where("kind = 'no_cycle'").first().json.startswith('{"kind":"no_cycle","scope":["a/**"],"severity"')

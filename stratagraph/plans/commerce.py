"""Queries over the commerce, pages, documents and event views, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.functions.paths import confidence_rank, effective_support, fingerprint, naming_score, package_id, prevalence_support, score_confidence, weighted_score
from stratagraph.operators import catalog, constructions, extract, graph, mining, policy, report, resolve, rule_index, workspaces
from stratagraph.operators.policy import Rule
from stratagraph.sources import repository
from stratagraph.sources import tabular as t
from stratagraph.sources.written import cut

RULES = [
    Rule("CM-001", "no_import", "error", ["ASIA/**"], ["EUROPE/**/suppliers/**"], ["**/MACHINERY/**"]),
    Rule("CM-002", "no_package", "warning", ["AMERICA/**"], ["@Brand1/*", "@Brand2/PROMO"]),
    Rule("CM-003", "file_pattern", "warning", ["AFRICA/**"], ["^cust[0-9]*[02468][.]customer$"]),
    Rule("CM-004", "pattern", "error", ["MIDDLE_EAST/**"], ["AFRICA/NATION_*/suppliers/**"], template="dependency_constraint"),
    Rule("CM-005", "pattern", "warning", ["EUROPE/**/BUILDING/**"], ["@Brand25/**"], template="dependency_constraint", params={"relation": "packages"}),
]
BASE = """
WITH place AS (SELECT n_nationkey, replace(r_name, ' ', '_') || '/' || replace(n_name, ' ', '_') AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey, place || '/' || c_mktsegment || '/cust' || c_custkey || '.customer' AS path FROM customer JOIN place ON c_nationkey = n_nationkey),
supp AS (SELECT s_suppkey, place || '/suppliers/supp' || s_suppkey || '.supplier' AS path FROM supplier JOIN place ON s_nationkey = n_nationkey),
files AS (SELECT 'commerce' AS repo_id, path FROM cust UNION ALL SELECT 'commerce', path FROM supp),
loc AS (SELECT DISTINCT c.path AS source_file, './supp' || l_suppkey AS raw_import, s.path AS resolved_path, (l_suppkey % 97 + 1)::INT AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust c ON o_custkey = c_custkey JOIN supp s ON l_suppkey = s_suppkey),
pkg AS (SELECT DISTINCT c.path AS source_file, '@' || replace(p_brand, '#', '') || '/' || p_type || '/' || replace(p_name, ' ', '-') AS raw_import FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN cust c ON o_custkey = c_custkey),
canon AS (SELECT *, regexp_extract(raw_import, '^(@[^/]+/[^/]+)', 1) AS pkg, (length(raw_import) % 50 + 1)::INT AS line FROM pkg),
nodes AS (SELECT regexp_replace(path, '/[^/]*$', '') AS subtree, count(*) AS n_files FROM files GROUP BY 1),
edges AS (SELECT regexp_replace(source_file, '/[^/]*$', '') AS src, regexp_replace(resolved_path, '/[^/]*$', '') AS dst, count(DISTINCT source_file) AS n_files FROM loc GROUP BY 1, 2 HAVING src <> dst),
pkg_edges AS (SELECT regexp_replace(source_file, '/[^/]*$', '') AS src, pkg, count(DISTINCT source_file) AS n_files FROM canon WHERE pkg <> '' GROUP BY 1, 2),
activity AS (SELECT subtree, sum(n)::BIGINT AS activity FROM (SELECT regexp_replace(source_file, '/[^/]*$', '') AS subtree, 1 AS n FROM loc UNION ALL SELECT src, n_files FROM pkg_edges) GROUP BY 1)
"""
F1 = "SELECT 'CM-001' AS rule_id, 'no_import' AS rule_kind, 'error' AS severity, source_file || ' imports ' || resolved_path AS message, source_file AS file_path, line, 1 AS \"column\", raw_import FROM loc WHERE regexp_matches(source_file, '^ASIA/') AND regexp_matches(resolved_path, '^EUROPE/(.*/)?suppliers/') AND NOT regexp_matches(source_file, '/MACHINERY/') AND NOT regexp_matches(resolved_path, '/MACHINERY/')"
F2 = "SELECT 'CM-002', 'no_package', 'warning', source_file || ' imports package ' || raw_import, source_file, line, 1, raw_import FROM canon WHERE regexp_matches(source_file, '^AMERICA/') AND (regexp_matches(raw_import, '^@Brand1/[^/]*$') OR regexp_matches(pkg, '^@Brand1/[^/]*$') OR raw_import = '@Brand2/PROMO' OR pkg = '@Brand2/PROMO')"
F3 = "SELECT 'CM-003', 'file_pattern', 'warning', path || ' does not match required file pattern', path, 1, 1, '' FROM files WHERE regexp_matches(path, '^AFRICA/') AND NOT regexp_matches(path, '/cust[0-9]*[02468][.]customer$')"
F4 = "SELECT 'CM-004', 'pattern', 'error', source_file || ' imports ' || resolved_path, source_file, line, 1, raw_import FROM loc WHERE regexp_matches(source_file, '^MIDDLE_EAST/') AND regexp_matches(resolved_path, '^AFRICA/NATION_[^/]*/suppliers/')"
F5 = "SELECT 'CM-005', 'pattern', 'warning', source_file || ' imports package ' || raw_import, source_file, line, 1, raw_import FROM canon WHERE regexp_matches(source_file, '^EUROPE/(.*/)?BUILDING/') AND (raw_import LIKE '@Brand25/%' OR pkg LIKE '@Brand25/%')"
CUST = "regexp_extract({}, '/cust([0-9]+)[.]customer$', 1)"
M1 = f"SELECT 'MR-' || k, 'no_import', 'error', source_file || ' imports ' || resolved_path, source_file, line, 1, raw_import FROM (SELECT *, {CUST.format('source_file')}::INT AS k FROM loc) WHERE k < 5000 AND k % 3 = 0 AND regexp_matches(resolved_path, '^(ASIA|AFRICA)/') AND NOT regexp_matches(source_file, '/MACHINERY/')"
M2 = f"SELECT 'MR-' || k, 'no_package', 'warning', source_file || ' imports package ' || raw_import, source_file, line, 1, raw_import FROM (SELECT *, {CUST.format('source_file')}::INT AS k FROM canon) WHERE k < 5000 AND k % 3 = 1 AND regexp_matches(raw_import, '^@Brand1[^/]*/')"
M3 = f"SELECT 'MR-' || k, 'file_pattern', 'warning', path || ' does not match required file pattern', path, 1, 1, '' FROM (SELECT *, {CUST.format('path')} AS c, try_cast({CUST.format('path')} AS INT) AS k FROM files) WHERE k < 5000 AND k % 3 = 2 AND k % 2 = 1"
COLUMNS = ("rule_id", "rule_kind", "severity", "message", "file_path", "line", "column", "raw_import", "fingerprint", "details")
PRINT = "sha1(rule_id || '|' || file_path || '|' || line || ':' || \"column\" || '|' || raw_import || '|')"


def _named(sql: str) -> str:
    names = "rule_id, rule_kind, severity, message, file_path, line, \"column\", raw_import"
    return f"SELECT DISTINCT {names}, {PRINT} AS fingerprint, '' AS details FROM ({sql}) AS f({names})"


def _found(parts: list[str]) -> str:
    return BASE + ", found AS (" + _named(" UNION ALL ".join(parts)) + ") "


def _findings(spark, sf_dir, rules):
    return policy.evaluate(rules, t.commerce_files(spark, sf_dir), t.commerce_imports(spark, sf_dir)).select(*COLUMNS)


def _many_rules(n: int = 5000) -> list[Rule]:
    """A rule for each of n names of files, by turns on imports, packages and the file's own name, besides RULES."""
    rules = []
    for k in range(n):
        scope = [f"**/cust{k}.customer"]
        if k % 3 == 0:
            rules.append(Rule(f"MR-{k}", "no_import", "error", scope, ["{ASIA,AFRICA}/**/suppliers/*.supplier"], ["**/MACHINERY/**"]))
        elif k % 3 == 1:
            rules.append(Rule(f"MR-{k}", "no_package", "warning", scope, ["@Brand1*/*/**"]))
        else:
            rules.append(Rule(f"MR-{k}", "file_pattern", "warning", scope, ["^cust[0-9]*[02468][.]customer$"]))
    return [*RULES, *rules]


def _findings_many_rules(spark, sf_dir):
    return rule_index.evaluate_indexed(_many_rules(), t.commerce_files(spark, sf_dir), t.commerce_imports(spark, sf_dir)).select(*COLUMNS)


def _summary(spark, sf_dir):
    files, imports = t.commerce_files(spark, sf_dir), t.commerce_imports(spark, sf_dir)
    return policy.summary(policy.evaluate(RULES, files, imports), files, imports)


SUMMARY_SQL = ", summary AS (SELECT 'commerce' AS repo_id, (SELECT count(*) FROM files) AS files_scanned, (SELECT count(*) FROM loc) + (SELECT count(*) FROM canon) AS imports_scanned, count(*) AS findings_total, count(*) FILTER (severity = 'error') AS findings_error, count(*) FILTER (severity = 'warning') AS findings_warning, 0::BIGINT AS parse_errors, 0::BIGINT AS files_skipped FROM found) "


def _rule(k: int):
    return lambda spark, sf_dir: _findings(spark, sf_dir, [RULES[k]])


def _graph(spark, sf_dir):
    """Nodes, edges, package edges and file edges; the imports are built once and written."""
    files, imports = t.commerce_files(spark, sf_dir), cut(t.commerce_imports(spark, sf_dir), "imports")
    return graph.nodes(files), graph.edges(imports), graph.package_edges(imports), graph.file_edges(imports)


def _activity(spark, sf_dir):
    _, _, packages, local = _graph(spark, sf_dir)
    return graph.source_activity(local, packages)


# The commerce graph is nearly complete, so that supports and prevalences are chosen for it to have both kinds of candidates.
SUPPORT, PREVALENCE = 5, 0.3


def _pairs(kind: str):
    def made(spark, sf_dir):
        nodes, edges, packages, local = _graph(spark, sf_dir)
        activity = graph.source_activity(local, packages)
        if kind == "no_import":
            return mining.pairs(kind, nodes, edges, "dst", nodes.select("repo_id", F.col("subtree").alias("target")), activity, SUPPORT, PREVALENCE)
        packages = cut(packages, "package-edges")
        return mining.pairs(kind, nodes, packages, "pkg", packages.select("repo_id", F.col("pkg").alias("target")).distinct(), activity, SUPPORT, PREVALENCE)

    return made


def _pairs_sql(kind: str) -> str:
    edges, target, targets, least, skip, extra = ("edges", "dst", "SELECT subtree AS target FROM nodes", SUPPORT, "AND s.subtree <> t.target", "") if kind == "no_import" else ("pkg_edges", "pkg", "SELECT DISTINCT pkg AS target FROM pkg_edges", SUPPORT // 2, "", "WHEN violations = 0 AND NOT (CASE WHEN target LIKE 'node:%' THEN true WHEN target LIKE '@%' THEN regexp_matches(target, '^@[^/]+/[^/]+') ELSE NOT regexp_matches(target, '[A-Z]') END) THEN 'zero_non_ecosystem_target'")
    return BASE + f""",
usage AS (SELECT {target} AS target, sum(n_files)::BIGINT AS usage, count(*) AS spread FROM {edges} GROUP BY 1),
act AS (SELECT count(*) AS sources FROM nodes WHERE n_files >= {SUPPORT}),
p AS (SELECT s.subtree AS scope, t.target, s.n_files AS support, coalesce(e.n_files, 0) AS violations, coalesce(u.usage, 0) AS usage, coalesce(u.spread, 0) AS spread, coalesce(a.activity, 0) AS activity, act.sources
  FROM nodes s CROSS JOIN ({targets}) t CROSS JOIN act LEFT JOIN usage u ON t.target = u.target LEFT JOIN {edges} e ON e.src = s.subtree AND e.{target} = t.target LEFT JOIN activity a ON a.subtree = s.subtree WHERE s.n_files >= {SUPPORT} {skip}),
pairs AS (SELECT '{kind}' AS kind, scope, target, support, violations, violations / support AS prevalence, usage, spread,
  CASE WHEN usage = 0 THEN 'target_never_observed' {extra} WHEN violations = 0 AND usage < {least} THEN 'zero_low_global_usage' WHEN violations = 0 AND activity = 0 THEN 'zero_inactive_source'
  WHEN violations = 0 AND spread > CASE WHEN sources <= 4 THEN sources ELSE greatest(3, sources // 4) END THEN 'zero_target_over_spread' WHEN violations > 0 AND violations / support > {PREVALENCE} THEN 'prevalence_over_limit' END AS drop_reason FROM p)
"""


CONF = "CASE WHEN prevalence <= 0.01 AND support >= 50 THEN 'HIGH' WHEN prevalence <= 0.02 AND support >= 20 THEN 'MEDIUM' ELSE 'LOW' END"
PAIR = ["kind", "scope", "target", "support", "violations", "prevalence", "usage", "spread", "drop_reason"]
CAND = ["kind", "scope", "target", "severity", "support", "violations", "prevalence", "confidence", "evidence"]
CAND_SQL = f"""cand AS (SELECT kind, scope || '/**' AS scope, CASE WHEN kind = 'no_import' THEN target || '/**' ELSE target END AS target, 'warning' AS severity, support, violations, prevalence, {CONF} AS confidence, violations || '/' || support || ' files in ' || scope || ' import ' || target AS evidence FROM pairs WHERE drop_reason IS NULL)"""


def _open(kind: str):
    """The pairs that are not dropped, each side filtered before they are paired."""

    def made(spark, sf_dir):
        nodes, edges, packages, local = _graph(spark, sf_dir)
        e = cut(edges if kind == "no_import" else packages, "edges")
        activity = cut(graph.source_activity(local, packages if kind == "no_import" else e), "activity")
        target = "dst" if kind == "no_import" else "pkg"
        return mining.open_pairs(kind, cut(nodes, "nodes"), e, target, activity, SUPPORT, PREVALENCE)

    return made


def _candidates(kind: str):
    return lambda spark, sf_dir: mining.candidates(_open(kind)(spark, sf_dir))


def _greedy(spark, sf_dir):
    """All pairs with their reasons, those of the caps too."""
    nodes, edges, packages, local = _graph(spark, sf_dir)
    packages = cut(packages, "package-edges")
    activity = cut(graph.source_activity(local, packages), "activity")
    s = mining.sides("no_package", nodes, packages, "pkg", activity, SUPPORT, PREVALENCE)
    accepted = cut(mining.greedy_accepted(s, SUPPORT), "accepted")
    every = mining.pairs("no_package", nodes, packages, "pkg", packages.select("repo_id", F.col("pkg").alias("target")).distinct(), activity, SUPPORT, PREVALENCE)
    return mining.greedy_caps(every, accepted, SUPPORT).select("kind", "scope", "target", "support", "violations", "drop_reason")


def _drop_counts(spark, sf_dir):
    nodes, edges, packages, local = _graph(spark, sf_dir)
    activity = graph.source_activity(local, packages)
    return mining.drop_counts("no_import", nodes, cut(edges, "edges"), "dst", nodes.select("repo_id", F.col("subtree").alias("target")), activity, SUPPORT, PREVALENCE).select("kind", "reason", "n")


def _siblings(spark, sf_dir):
    return mining.sibling_scopes(_candidates("no_package")(spark, sf_dir)).select(*CAND)


SIBLING_SQL = _pairs_sql("no_package") + ", " + CAND_SQL + f""",
c AS (SELECT *, CASE WHEN contains(scope[:-4], '/') THEN regexp_replace(scope[:-4], '/[^/]*$', '') ELSE '.' END AS parent FROM cand),
c2 AS (SELECT *, violations = 0 AND parent NOT IN ('.', '/', '') AS can FROM c),
g AS (SELECT kind, target, parent, count(*) AS n, sum(support)::BIGINT AS support FROM c2 WHERE can GROUP BY ALL HAVING count(*) >= 2)
SELECT kind, scope, target, severity, support, violations, prevalence, confidence, evidence FROM c2 WHERE NOT can OR NOT EXISTS (SELECT 1 FROM g WHERE g.kind = c2.kind AND g.target = c2.target AND g.parent = c2.parent)
UNION ALL SELECT kind, parent || '/**', target, 'warning', support, 0, 0.0, CASE WHEN support >= 50 THEN 'HIGH' WHEN support >= 20 THEN 'MEDIUM' ELSE 'LOW' END, '0/' || support || ' files across ' || n || ' sibling scopes under ' || parent || ' import ' || target FROM g"""
MOST = 60
CAP_SQL = _pairs_sql("no_package") + ", " + CAND_SQL + f""",
r AS (SELECT *, count(*) OVER () AS n_all, sum((violations > 0)::INT) OVER () AS n_bad, row_number() OVER (PARTITION BY violations > 0 ORDER BY CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, support DESC, prevalence, violations, scope, target) AS k FROM cand)
SELECT kind, scope, target, severity, support, violations, prevalence, confidence, evidence FROM r WHERE n_all <= {MOST} OR (violations > 0 AND k <= {MOST}) OR (violations = 0 AND k <= greatest(0, least(CASE WHEN n_bad = 0 THEN least({MOST // 2}, {MOST // 3}) ELSE {MOST // 2} END, {MOST} - n_bad)))"""
GLOBS = ["**/BUILDING/**"], ["**/suppliers/**"]


def _catalog(spark, sf_dir):
    c = _candidates("no_import")(spark, sf_dir)
    support = prevalence_support(F.col("prevalence"), F.col("support"), 0.02, effective_support(20, F.col("support")))
    naming = naming_score(F.col("scope"), F.col("target"), ["**/app/**", "**/suppliers/**"])
    c = c.where(F.col("scope").rlike("/BUILDING/") & F.col("target").rlike("/suppliers/"))
    scored = c.withColumn("raw", weighted_score(F.lit(1.0), support, naming))
    return scored.select("scope", "target", F.round("raw", 9).alias("score"), score_confidence(F.col("raw")).alias("score_confidence"), confidence_rank(F.col("confidence")).alias("mined_rank"))


CATALOG_SQL = _pairs_sql("no_import") + ", " + CAND_SQL + """,
s AS (SELECT *, (least(1.0, support / least(20, greatest(3, support))) + CASE WHEN prevalence > 0.02 THEN greatest(0.0, least(1.0, 1.0 - (prevalence - 0.02) / 0.98)) ELSE 1.0 END) / 2.0 AS ps,
  (lower(scope) LIKE '%app%' OR lower(target) LIKE '%app%')::INT::DOUBLE AS nm FROM cand WHERE regexp_matches(scope, '/BUILDING/') AND regexp_matches(target, '/suppliers/')),
w AS (SELECT *, greatest(0.0, least(1.0, 0.4 * 1.0 + 0.4 * ps + 0.2 * nm)) AS raw FROM s)
SELECT scope, target, round(raw, 9) AS score, CASE WHEN raw >= 0.85 THEN 'HIGH' WHEN raw >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS score_confidence, CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS mined_rank FROM w"""
DOC_SQL = "WITH files AS (SELECT coalesce(lang, 'none') || '/' || coalesce(source, 'none') AS subtree, CASE WHEN n_chars % 7 = 0 THEN '.draft.txt' ELSE '.txt' END AS suffix FROM documents WHERE doc_id IS NOT NULL), cnt AS (SELECT subtree, suffix, count(*) AS n FROM files GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY subtree ORDER BY n DESC, suffix) AS k, sum(n) OVER (PARTITION BY subtree)::BIGINT AS total FROM cnt) "


def _event_cycles(spark, sf_dir):
    return graph.components(t.event_edges(spark, sf_dir, 2)).select("node", "component")


EVENT_SQL = "WITH RECURSIVE seq AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT src, dst, count(DISTINCT user_id) AS n_files FROM seq WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL HAVING count(DISTINCT user_id) >= 2), reach AS (SELECT src AS u, dst AS v FROM e UNION SELECT r.u, e.dst FROM reach r JOIN e ON r.v = e.src) "


def _page_resolve(spark, sf_dir):
    files, links = t.page_files(spark, sf_dir), t.page_links(spark, sf_dir)
    return resolve.resolve_imports(links, files).select("repo_id", "source_file", "raw_import", "resolved_path", "is_package")


PAGES = "WITH f AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo_id, regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '^[a-z]+://[^/]+/(.*)$', 1) AS path FROM pages WHERE url IS NOT NULL), l AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo_id, regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '^[a-z]+://[^/]+/(.*)$', 1) AS source_file, unnest(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS raw_import FROM pages WHERE url IS NOT NULL AND html IS NOT NULL) "
EXT = "(VALUES ('', 0), ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4), ('.mjs', 5), ('.cjs', 6), ('.php', 7), ('/index.ts', 8), ('/index.tsx', 9), ('/index.js', 10), ('/index.jsx', 11), ('/index.mjs', 12), ('/index.cjs', 13), ('/index.php', 14)) AS x(ext, k)"
PAGE_SQL = PAGES + f", c AS (SELECT l.*, ltrim(raw_import, '/') AS want FROM l), r AS (SELECT c.repo_id, c.source_file, c.raw_import, arg_min(f.path, k) AS resolved_path FROM c CROSS JOIN {EXT} JOIN f ON f.repo_id = c.repo_id AND f.path = c.want || x.ext AND c.raw_import LIKE '/%' GROUP BY ALL) SELECT DISTINCT c.repo_id, c.source_file, c.raw_import, r.resolved_path, NOT (c.raw_import LIKE '/%' OR c.raw_import LIKE '.%') AS is_package FROM c LEFT JOIN r ON r.repo_id = c.repo_id AND r.source_file = c.source_file AND r.raw_import = c.raw_import"


def _construction_facts(spark, sf_dir):
    """Customers construct the services of their suppliers: every third supplier exports no class, and every fifth part is made by a computed name."""
    local = t.commerce_local(spark, sf_dir)
    number = F.regexp_extract("resolved_path", "supp([0-9]+)", 1).cast("long")
    local = cut(local.select("repo_id", "source_file", "resolved_path", "line", "column", number.alias("k")), "local")
    name = F.concat(F.lit("Supp"), "k", F.lit("Service"))
    news = local.select("repo_id", F.col("source_file").alias("file"), name.alias("class_name"), "line", "column", (F.col("k") % 5 != 0).alias("is_identifier"))
    bindings = local.select("repo_id", F.col("source_file").alias("file"), name.alias("local"), name.alias("imported"), "resolved_path").where("k % 7 <> 0")
    files = t.commerce_files(spark, sf_dir)
    supplier = files.where("path like '%.supplier'").select("repo_id", F.col("path").alias("file"), F.concat(F.lit("Supp"), F.regexp_extract("path", "supp([0-9]+)", 1), F.lit("Service")).alias("name"), F.regexp_extract("path", "supp([0-9]+)", 1).cast("long").alias("k")).where("k % 3 <> 0")
    classes = supplier.select("repo_id", "file", "name")
    exports = supplier.select("repo_id", "file", F.col("name").alias("export_name"), F.col("name").alias("local_class"))
    return files, news, bindings, classes, exports


def _constructions(spark, sf_dir):
    files, news, bindings, classes, exports = _construction_facts(spark, sf_dir)
    c = constructions.resolve_constructions(files, news, bindings, classes, exports, ["EUROPE/**"], ".*Service$")
    return c.select("file", "line", "class_name", "resolved_file", "resolved_class", "is_resolved", "is_service", "unresolved_reason")


CONSTRUCTION_SQL = BASE + """, n AS (SELECT source_file AS file, line, regexp_extract(resolved_path, 'supp([0-9]+)', 1)::BIGINT AS k, resolved_path FROM loc),
r AS (SELECT *, 'Supp' || k || 'Service' AS class_name, CASE WHEN k % 5 = 0 THEN 'dynamic_constructor' WHEN k % 7 = 0 THEN 'symbol_not_resolved' WHEN k % 3 = 0 THEN 'imported_symbol_not_class' END AS reason FROM n)
SELECT file, line, class_name, CASE WHEN reason IS NULL THEN resolved_path END AS resolved_file, CASE WHEN reason IS NULL THEN class_name END AS resolved_class, reason IS NULL AS is_resolved, reason IS NULL AND resolved_path LIKE 'EUROPE/%' AS is_service, reason AS unresolved_reason FROM r"""


def _bare(kind):
    return lambda spark, sf_dir: _pairs(kind)(spark, sf_dir).select(*PAIR)


def _facts(spark, sf_dir):
    return extract.facts(t.order_sources(spark, sf_dir))


#: Places follow from the text of order_sources: the blanked comment counts as blank space before the first statement.
ORDER_FILES = "SELECT 'orders' AS repo_id, 'orders/' || o_orderkey || '.ts' AS source_file, "
EXTRACT_SQL = ORDER_FILES + "'./cust' || o_custkey AS raw_import, 1 AS line, 1 AS \"column\", 'import' AS kind FROM orders UNION ALL " + ORDER_FILES + "'@pri/p' || o_orderkey % 5, 3, 11, 'require' FROM orders"


def _upper(c):
    return F.regexp_replace(c, "/[A-Z]+$", "/[segment]")


BOUNDARIES = (
    catalog.Boundary("CAT-BUILDING-SUPPLIERS", "Building avoids suppliers", "layering", "Building customers should not depend on suppliers.", "no_import", ("**/BUILDING/**",), ("**/suppliers/**",)),
    catalog.Boundary("CAT-EUROPE-SUPPLIERS", "Europe avoids suppliers", "layering", "European customers should not depend on suppliers.", "no_import", ("EUROPE/**",), ("**/suppliers/**",), 0.03),
)


def _boundary_matches(spark, sf_dir):
    m = catalog.boundary_matches(_candidates("no_import")(spark, sf_dir), BOUNDARIES, show_low=True)
    return m.select("catalog_id", "relation", "scope", "target", "support", "violations", "prevalence", F.round("score", 9).alias("score"), "confidence")


BOUNDARY_SQL = _pairs_sql("no_import") + ", " + CAND_SQL + """,
m AS (SELECT 'CAT-BUILDING-SUPPLIERS' AS catalog_id, 0.02::DOUBLE AS mp, (lower(scope) LIKE '%ui%' OR lower(target) LIKE '%ui%')::INT::DOUBLE AS nm, * FROM cand WHERE regexp_matches(scope, '/BUILDING/') AND regexp_matches(target, '/suppliers/')
  UNION ALL SELECT 'CAT-EUROPE-SUPPLIERS', 0.03::DOUBLE, 0.6::DOUBLE, * FROM cand WHERE regexp_matches(scope, '^EUROPE/') AND regexp_matches(target, '/suppliers/')),
s AS (SELECT *, (least(1.0, support / least(20, greatest(3, support))) + CASE WHEN prevalence > mp THEN greatest(0.0, least(1.0, 1.0 - (prevalence - mp) / (1.0 - mp))) ELSE 1.0 END) / 2.0 AS ps FROM m),
w AS (SELECT *, greatest(0.0, least(1.0, 0.4 + 0.4 * ps + 0.2 * nm)) AS raw FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY scope, target ORDER BY raw DESC, catalog_id) AS k FROM w)
SELECT catalog_id, 'imports' AS relation, scope, target, support, violations, prevalence, round(raw, 9) AS score, CASE WHEN raw >= 0.85 THEN 'HIGH' WHEN raw >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM k WHERE k = 1"""

QUERIES = {
    "catalog_matches": _boundary_matches,
    "discovered_files": lambda s, d: repository.discovered(t.commerce_files(s, d), ["EUROPE/**", "ASIA/**"], ["**/MACHINERY", "ASIA/*/suppliers/**"]).select("repo_id", "path"),
    "workspace_roots": lambda s, d: workspaces.workspace_roots(t.customer_manifests(s, d)),
    "nodes_by_subtree": lambda s, d: graph.nodes(t.commerce_files(s, d)),
    "subtree_edges": lambda s, d: graph.edges(t.commerce_imports(s, d)),
    "package_edges": lambda s, d: graph.package_edges(t.commerce_imports(s, d)),
    "file_edges": lambda s, d: graph.file_edges(t.commerce_imports(s, d)),
    "source_activity": lambda s, d: _activity(s, d).select("subtree", "activity"),
    "target_usage": lambda s, d: graph.target_usage(graph.edges(t.commerce_imports(s, d)), "dst").select("target", "usage", "spread"),
    "rule_no_import": _rule(0),
    "rule_no_package": _rule(1),
    "rule_file_pattern": _rule(2),
    "dependency_constraint_imports": _rule(3),
    "dependency_constraint_packages": _rule(4),
    "findings_all_rules": lambda s, d: _findings(s, d, RULES),
    "findings_many_rules": _findings_many_rules,
    "findings_top_n": lambda s, d: policy.ordered(_findings(s, d, RULES), 100),
    "findings_summary": _summary,
    "package_canonical": lambda s, d: t.commerce_packages(s, d).select("raw_import", package_id("raw_import").alias("pkg")).distinct(),
    "finding_fingerprint": lambda s, d: t.commerce_local(s, d).select("source_file", "raw_import", fingerprint(F.lit("CM-009"), F.col("source_file"), F.col("line"), F.col("column"), F.col("raw_import"), F.lit(None)).alias("fingerprint")),
    "changed_files": lambda s, d: policy.changed_only(t.commerce_files(s, d), t.commerce_changed(s, d)).select("path"),
    "mine_no_import": _bare("no_import"),
    "mine_no_package": _bare("no_package"),
    "mine_candidates": lambda s, d: _candidates("no_import")(s, d).select(*CAND),
    "mine_greedy_cap": _greedy,
    "drop_stats": _drop_counts,
    "mine_sibling_aggregate": _siblings,
    "mine_ranked_cap": lambda s, d: mining.ranked_cap(_candidates("no_package")(s, d), MOST).select(*CAND),
    "catalog_score": _catalog,
    "suffix_mode": lambda s, d: mining.dominant_suffix(t.document_files(s, d)).select("subtree", "suffix", "n"),
    "mine_file_pattern": lambda s, d: mining.file_patterns(t.document_files(s, d), 5).select("scope", "target", "support", "violations", "prevalence", "confidence", "evidence"),
    "cycle_components": _event_cycles,
    "no_cycle_chains": lambda s, d: graph.cycles(t.event_edges(s, d, 2)).select("component", "chain"),
    "normalised_graph": lambda s, d: graph.normalised_graph(graph.edges(t.commerce_imports(s, d)), _upper).select("src", "dst", "n_files"),
    "resolve_imports": _page_resolve,
    "constructions": _constructions,
    "extract_imports": lambda s, d: extract.imports(_facts(s, d)).select("repo_id", "source_file", "raw_import", "line", "column", "kind"),
    "extract_constructions": lambda s, d: extract.constructions(_facts(s, d)),
    "findings_text": lambda s, d: report.text_findings(policy.evaluate(RULES, t.commerce_files(s, d), t.commerce_imports(s, d))).select("heading", "text"),
}
SQL = {
    "catalog_matches": BOUNDARY_SQL,
    "discovered_files": BASE + "SELECT repo_id, path FROM files WHERE (path LIKE 'EUROPE/%' OR path LIKE 'ASIA/%') AND path NOT LIKE '%/MACHINERY/%' AND NOT regexp_matches(path, '^ASIA/[^/]*/suppliers/')",
    "workspace_roots": "WITH k AS (SELECT 'm' || c_custkey % 5 AS repo_id, c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'packages/c' WHEN 1 THEN 'apps/x/c' END || c_custkey AS workspace FROM customer WHERE c_custkey % 3 < 2) SELECT repo_id, workspace FROM k WHERE (repo_id IN ('m0', 'm2', 'm3') AND k % 3 = 0) OR (repo_id IN ('m1', 'm2') AND k % 3 = 1)",
    "nodes_by_subtree": BASE + "SELECT 'commerce' AS repo_id, * FROM nodes",
    "subtree_edges": BASE + "SELECT 'commerce' AS repo_id, * FROM edges",
    "package_edges": BASE + "SELECT 'commerce' AS repo_id, * FROM pkg_edges",
    "file_edges": BASE + "SELECT DISTINCT 'commerce' AS repo_id, source_file AS src_file, resolved_path AS dst_file FROM loc",
    "source_activity": BASE + "SELECT * FROM activity",
    "target_usage": BASE + "SELECT dst AS target, sum(n_files)::BIGINT AS usage, count(*) AS spread FROM edges GROUP BY 1",
    "rule_no_import": _found([F1]) + "SELECT * FROM found",
    "rule_no_package": _found([F2]) + "SELECT * FROM found",
    "rule_file_pattern": _found([F3]) + "SELECT * FROM found",
    "dependency_constraint_imports": _found([F4]) + "SELECT * FROM found",
    "dependency_constraint_packages": _found([F5]) + "SELECT * FROM found",
    "findings_all_rules": _found([F1, F2, F3, F4, F5]) + "SELECT * FROM found",
    "findings_many_rules": _found([F1, F2, F3, F4, F5, M1, M2, M3]) + "SELECT * FROM found",
    "findings_top_n": _found([F1, F2, F3, F4, F5]) + 'SELECT * FROM found ORDER BY severity, rule_id, file_path, line, "column", fingerprint LIMIT 100',
    "findings_summary": _found([F1, F2, F3, F4, F5]) + SUMMARY_SQL + "SELECT * FROM summary",
    "package_canonical": BASE + "SELECT DISTINCT raw_import, pkg FROM canon",
    "finding_fingerprint": BASE + "SELECT source_file, raw_import, sha1('CM-009|' || source_file || '|' || line || ':1|' || raw_import || '|') AS fingerprint FROM loc",
    "changed_files": BASE + "SELECT path FROM cust WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')",
    "mine_no_import": _pairs_sql("no_import") + "SELECT * FROM pairs",
    "mine_no_package": _pairs_sql("no_package") + "SELECT * FROM pairs",
    "mine_candidates": _pairs_sql("no_import") + ", " + CAND_SQL + "SELECT * FROM cand",
    "drop_stats": _pairs_sql("no_import") + "SELECT kind, drop_reason AS reason, count(*) AS n FROM pairs WHERE drop_reason IS NOT NULL GROUP BY ALL",
    "mine_sibling_aggregate": SIBLING_SQL,
    "mine_ranked_cap": CAP_SQL,
    "catalog_score": CATALOG_SQL,
    "suffix_mode": DOC_SQL + "SELECT subtree, suffix, n FROM best WHERE k = 1",
    "mine_file_pattern": DOC_SQL + "SELECT subtree || '/**' AS scope, '^.*' || replace(suffix, '.', '\\.') || '$' AS target, total AS support, total - n AS violations, (total - n) / total AS prevalence, 'HIGH' AS confidence, n || '/' || total || ' files in ' || subtree || ' match suffix ' || suffix AS evidence FROM best WHERE k = 1 AND total >= 5 AND (total - n) / total <= 0.20",
    "cycle_components": EVENT_SQL + "SELECT a.u AS node, min(a.v) AS component FROM reach a JOIN reach b ON a.u = b.v AND a.v = b.u GROUP BY 1",
    "normalised_graph": BASE + "SELECT regexp_replace(src, '/[A-Z]+$', '/[segment]') AS src, regexp_replace(dst, '/[A-Z]+$', '/[segment]') AS dst, sum(n_files)::BIGINT AS n_files FROM edges GROUP BY 1, 2 HAVING src <> dst",
    "resolve_imports": PAGE_SQL,
    "constructions": CONSTRUCTION_SQL,
    "extract_imports": EXTRACT_SQL,
    "extract_constructions": "SELECT 'orders' AS repo_id, 'orders/' || o_orderkey || '.ts' AS file, 'Cust' AS class_name, 5 AS line, 11 AS \"column\", true AS is_identifier FROM orders",
    "findings_text": _found([F1, F2, F3, F4, F5]) + "SELECT rule_id || ' (' || severity || ')' AS heading, '  - ' || file_path || ':' || line || ':' || \"column\" || ' ' || message || CASE WHEN raw_import <> '' THEN ' (import: ' || raw_import || ')' ELSE '' END AS text FROM found",
}

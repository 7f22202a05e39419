"""The given tables seen as repositories: files that import files and packages.

commerce: customers and suppliers are files in region/nation/..., a customer
imports the suppliers it has bought from, and the brand/type/name of the parts
it has bought are packages. pages: a page is a file below its host, its links
are imports. documents: files by language and source. event_flow: transitions
between event types of a user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    under = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.concat(under("r_name"), F.lit("/"), under("n_name")).alias("place"))


def _customer_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(_places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.concat("place", F.lit("/"), "c_mktsegment").alias("directory"))


def customer_file(directory: Column | str, key: Column | str) -> Column:
    return F.concat(directory, F.lit("/cust"), key, F.lit(".customer"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_directories(spark, sf_dir).select("c_custkey", customer_file("directory", "c_custkey").alias("path"))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(_places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", F.concat("place", F.lit("/suppliers/supp"), "s_suppkey", F.lit(".supplier")).alias("path"))


def commerce_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("path").unionByName(_suppliers(spark, sf_dir).select("path")).select(F.lit("commerce").alias("repo_id"), "path")


def _bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def commerce_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _bought(spark, sf_dir).select("o_custkey", "l_suppkey").distinct()
    p = pairs.join(_customers(spark, sf_dir).withColumnRenamed("path", "source_file"), F.col("o_custkey") == F.col("c_custkey")).join(_suppliers(spark, sf_dir).withColumnRenamed("path", "resolved_path"), F.col("l_suppkey") == F.col("s_suppkey"))
    return p.select(F.lit("commerce").alias("repo_id"), "source_file", F.concat(F.lit("./supp"), "l_suppkey").alias("raw_import"), "resolved_path", F.lit(False).alias("is_package"), (F.col("l_suppkey") % 97 + 1).cast("int").alias("line"), F.lit(1).alias("column"), F.lit("import").alias("kind"))


def commerce_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("@"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("raw_import"))
    pairs = _bought(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey")).select("o_custkey", "raw_import").distinct()
    p = pairs.join(_customers(spark, sf_dir).withColumnRenamed("path", "source_file"), F.col("o_custkey") == F.col("c_custkey"))
    return p.select(F.lit("commerce").alias("repo_id"), "source_file", "raw_import", F.lit(None).cast("string").alias("resolved_path"), F.lit(True).alias("is_package"), (F.length("raw_import") % 50 + 1).cast("int").alias("line"), F.lit(1).alias("column"), F.lit("import").alias("kind"))


def commerce_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and packages that customers import, from one scan of what they have bought."""
    bought = _bought(spark, sf_dir).select("o_custkey", F.inline(F.array(*(F.struct(F.lit(k).alias("of"), F.col(c).cast("long").alias("key")) for k, c in enumerate(("l_suppkey", "l_partkey")))))).distinct()
    part = F.concat(F.lit("@"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")))
    parts = table(spark, sf_dir, "part").select(F.lit(1).alias("of"), F.col("p_partkey").cast("long").alias("key"), part.alias("raw_import"), F.lit(None).cast("string").alias("resolved_path"), F.lit(True).alias("is_package"))
    parts = parts.withColumn("line", (F.length("raw_import") % 50 + 1).cast("int"))
    files = _suppliers(spark, sf_dir).select(F.lit(0).alias("of"), F.col("s_suppkey").cast("long").alias("key"), F.concat(F.lit("./supp"), "s_suppkey").alias("raw_import"), F.col("path").alias("resolved_path"), F.lit(False).alias("is_package"), (F.col("s_suppkey") % 97 + 1).cast("int").alias("line"))
    held = bought.join(files.unionByName(parts), ["of", "key"]).join(_customers(spark, sf_dir).withColumnRenamed("path", "source_file"), F.col("o_custkey") == F.col("c_custkey"))
    # Parts of one name are one package.
    return held.select(F.lit("commerce").alias("repo_id"), "source_file", "raw_import", "resolved_path", "is_package", "line", F.lit(1).alias("column"), F.lit("import").alias("kind")).distinct()


def commerce_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order from 2001 on."""
    late = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")).select("o_custkey").distinct()
    return _customers(spark, sf_dir).join(late, F.col("c_custkey") == F.col("o_custkey")).select(F.lit("commerce").alias("repo_id"), "path")


def page_parts(url: Column) -> tuple[Column, Column]:
    """Host, and path without query and fragment."""
    bare = F.regexp_extract(url, "^([^?#]*)", 1)
    return F.regexp_extract(bare, "^[a-z]+://([^/]+)", 1), F.regexp_extract(bare, "^[a-z]+://[^/]+/(.*)$", 1)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = page_parts(F.col("url"))
    return table(spark, sf_dir, "pages").where("url is not null").select(host.alias("repo_id"), path.alias("path"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = page_parts(F.col("url"))
    href = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))))
    return table(spark, sf_dir, "pages").where("url is not null and html is not null").select(host.alias("repo_id"), path.alias("source_file"), href.alias("raw_import"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document has a draft suffix, so that naming rules have something to find."""
    ext = F.when(F.col("n_chars") % 7 == 0, ".draft.txt").otherwise(".txt")
    return table(spark, sf_dir, "documents").where("doc_id is not null").select(F.lit("documents").alias("repo_id"), F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/doc"), "doc_id", ext).alias("path"))


def event_edges(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """Edges between event types that follow each other for a user; n_files counts users."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null and src <> dst")
    return e.groupBy(F.lit("events").alias("repo_id"), "src", "dst").agg(F.countDistinct("user_id").alias("n_files")).where(F.col("n_files") >= least)


def order_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each order, with the imports, class and construction that follow from its keys."""
    k = F.col("o_orderkey").cast("string")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("/* import 'no/"), k, F.lit("' */")), F.concat(F.lit("import Cust, { Order as O"), k, F.lit(" } from './cust"), "o_custkey", F.lit("';")),
        F.concat(F.lit("const p = require(\"@pri/p"), (F.col("o_orderkey") % 5).cast("string"), F.lit("\");")), F.concat(F.lit("export class Order"), k, F.lit(" {}")), F.concat(F.lit("const s = new Cust(O"), k, F.lit(");")),
    )
    return table(spark, sf_dir, "orders").select(F.lit("orders").alias("repo_id"), F.concat(F.lit("orders/"), k, F.lit(".ts")).alias("path"), lines.alias("text"))


def customer_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of each customer in five repositories, which name their workspaces in different ways, the last not at all."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, F.concat(F.lit("m"), k % 5).alias("repo_id"))
    at = F.when(k % 3 == 0, "packages/c").when(k % 3 == 1, "apps/x/c").otherwise("packages/node_modules/c")
    held = c.select("repo_id", F.concat(at, k, F.lit("/package.json")).alias("path"), F.lit("{}").alias("text"))
    roots = [("m0", "package.json", '{"workspaces": ["packages/*"]}'), ("m1", "package.json", '{"workspaces": {"packages": ["./apps/**"]}}'), ("m2", "pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  - \"apps/*/*\"\n"), ("m3", "turbo.json", "{}")]
    named = c.select("repo_id").distinct().join(spark.createDataFrame(roots, "repo_id string, path string, text string"), "repo_id")
    return held.unionByName(named)


def nation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository for each nation with a script for each supplier, every third one in a folder of its own."""
    k = F.col("s_suppkey").cast("string")
    path = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("src/s/supp"), k, F.lit(".ts"))).otherwise(F.concat(F.lit("src/alt/supp"), k, F.lit("/index.ts")))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("repo_id"), path.alias("path"))


def nation_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of parts import the suppliers that a line item names by an alias, PHP files of odd nations by a namespace, and a package."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    used = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("p")).distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    k, odd = F.col("s_suppkey").cast("string"), F.col("s_nationkey") % 2 == 1
    script, php = (F.concat(F.lit("app/p"), "p", F.lit(e)) for e in (".ts", ".php"))
    one = lambda source, raw: F.struct(source.alias("source_file"), raw.alias("raw_import"))
    every = F.array(one(script, F.concat(F.lit("@s/supp"), k)), F.when(odd, one(php, F.concat(F.lit("App\\Sup\\supp"), k))), one(script, F.concat(F.lit("pkg"), F.col("s_suppkey") % 7, F.lit("/x"))))
    return used.select(F.concat(F.lit("n"), "s_nationkey").alias("repo_id"), F.inline(F.array_compact(every))).distinct()


def nation_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even nations keep their scripts below the base of a configuration with comments; odd ones have a namespace too."""
    n = table(spark, sf_dir, "supplier").select("s_nationkey").distinct()
    even = '// base\n{ "compilerOptions": { "baseUrl": "src", /* "paths": {} */ "paths": { "@s/*": ["s/*", "alt/*",], "@s": ["none//x"], }, }, }'
    odd = '{"compilerOptions": {"paths": {"@s/*": ["./src/alt/*", "src/s"]}}}'
    composer = '{"autoload": {"psr-4": {"App\\\\Sup\\\\": ["lib/", "src/s/"], "": "x/"}}}'
    is_odd = F.col("s_nationkey") % 2 == 1
    one = lambda path, text: F.struct(F.lit(path).alias("path"), text.alias("text"))
    rows = F.array(one("tsconfig.json", F.when(is_odd, odd).otherwise(even)), one("jsconfig.json", F.lit("{}")), F.when(is_odd, one("composer.json", F.lit(composer))))
    return n.select(F.concat(F.lit("n"), "s_nationkey").alias("repo_id"), F.inline(F.array_compact(rows)))


def form_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, directory, c_custkey): who has bought from whom, each once, dealt by suppliers.

    Keys alone are dealt before: once by orders, once by customers.
    """
    pairs = _bought(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("s_suppkey")).repartition("c_custkey").distinct()
    places = _customer_directories(spark, sf_dir).where("directory is not null").distinct()
    return pairs.join(places, "c_custkey").select("s_suppkey", "directory", "c_custkey").repartition("s_suppkey")


def same_numbers(spark: SparkSession, sf_dir: str) -> bool:
    """Whether places are named so that suppliers of several keys may have one number in their paths."""
    return not _places(spark, sf_dir).where(F.col("place").rlike("supp[0-9]")).isEmpty()


def form_imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Imports of every form a source may write, by the number of the supplier that is bought from, and the entries they may meet.

    Imports are (s_suppkey, end, raw_import): end is what follows a customer's file in the importing file's name.
    """
    k = F.regexp_extract("path", "supp([0-9]+)", 1).cast("long")
    n, number = F.col("k"), F.col("k").cast("string")
    one = lambda end, raw: F.struct(F.lit(end).alias("end"), raw.alias("raw_import"))
    by_rest = F.when(n % 4 == 0, one("", F.concat(F.lit("/"), "path"))).when(n % 4 == 1, one("", F.concat(F.lit("../../../"), "path", F.lit(".ts")))).when(n % 4 == 2, one(".php", F.concat(F.lit("@alias/"), "path"))).otherwise(one(".php", F.concat(F.lit("lib/"), number, F.lit(".PHP"))))
    rest = [one(".php", F.concat(F.lit("Bare_"), number)), one(".ts", F.concat(F.lit("Bare_"), number)), one(".php", F.concat(F.lit("lib\\Gone"), number)), one(".php", F.concat(F.lit("Other\\Gone"), number))]
    imports = _suppliers(spark, sf_dir).select("s_suppkey", "path", k.alias("k")).select("s_suppkey", F.inline(F.array(by_rest, *rest))).distinct()
    suppliers = _suppliers(spark, sf_dir).select(F.lit("commerce").alias("repo_id"), F.concat("path", F.lit(".ts")).alias("path"))
    held = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 8 == 3).select(F.lit("commerce").alias("repo_id"), F.concat(F.lit("lib/"), "s_suppkey", F.lit(".PHP")).alias("path"))
    top = table(spark, sf_dir, "region").limit(1).select(F.lit("commerce").alias("repo_id"), F.lit("lib/readme.md").alias("path"))
    return imports, suppliers.unionByName(held).unionByName(top)


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository for ten customers each; a customer's number says which files it has."""
    k = F.col("c_custkey")
    name = lambda n, text: F.when(k % n == 0, F.concat(F.lit("c"), k, F.lit(text)))
    every = F.array(F.concat(F.lit("c"), k, F.lit("/readme.md")), name(7, "/tsconfig.json"), name(3, "/x.mjs"), name(11, "/composer.json"), name(13, "/x.phtml"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.floor(k / 10)).alias("repo_id"), F.explode(F.array_compact(every)).alias("path"))


def _ring_place() -> dict[str, Column]:
    k = F.col("c_custkey")
    return {"repo_id": F.concat(F.lit("m"), k % 3), "g": F.floor(k / 12).cast("string"), "i": F.floor(k % 12 / 3)}


def ring_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files of three repositories, four directories to a ring."""
    p = _ring_place()
    return table(spark, sf_dir, "customer").select(p["repo_id"].alias("repo_id"), F.concat(F.lit("ring"), p["g"], F.lit("/n"), p["i"], F.lit("/c"), "c_custkey", F.lit(".ts")).alias("path"))


def ring_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each directory of a ring imports the next, the last the first, and the first also the ring before; a ring that lacks a directory is open."""
    p = _ring_place()
    at = lambda g, i: F.concat(F.lit("ring"), g, F.lit("/n"), i, F.lit("/x.ts"))
    one = lambda path: F.struct(path.alias("resolved_path"), F.concat(F.lit("../"), path).alias("raw_import"))
    back = F.when((p["i"] == 0) & (F.col("c_custkey") >= 12), one(at((F.floor(F.col("c_custkey") / 12) - 1).cast("string"), F.lit(0))))
    every = F.array_compact(F.array(one(at(p["g"], (p["i"] + 1) % 4)), back))
    d = table(spark, sf_dir, "customer").select(p["repo_id"].alias("repo_id"), at(p["g"], p["i"]).alias("source_file"), F.inline(every))
    return d.select("*", F.lit(False).alias("is_package"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("import").alias("kind"))


def customer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source text for each customer: classes and bindings, re-exports and computed imports, or PHP, of which every fifth is broken."""
    k = F.col("c_custkey")
    n = k.cast("string")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit("import D, {A as B} from './m"), n, F.lit("';\nexport default class X"), n, F.lit(" {}\nclass Y {} // class No\nexport { Y as Yy };\nnew Y(); new B();\n")))
        .when(k % 3 == 1, F.concat(F.lit("export * from './area"), k % 7, F.lit("';\n/* import 'no' */ const f = import('./dyn"), n, F.lit("');\nconst s = \"require('no')\";\n")))
        .when(k % 5 == 0, F.concat(F.lit("<?php use A"), n, F.lit("; function (")))
        .otherwise(F.concat(F.lit("<p>use No\\One;</p>\n<?php\nuse A"), n, F.lit("\\B, C\\D as E;\nuse F\\{G, H\\I as J};\n# use No\\Two;\nrequire 'l"), n, F.lit(".php';\n")))
    )
    end = F.when(k % 3 == 2, ".php").otherwise(".tsx")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), k % 4).alias("repo_id"), F.concat(F.lit("c"), n, end).alias("path"), text.alias("text"))


def framework_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three repositories, a customer each, and the files that tell their frameworks: (repo_id, path, text, target), target being what a file imports."""
    k = F.col("c_custkey")
    part = lambda before, n, after: F.concat(F.lit(before), k % n, F.lit(after))
    of = lambda next_, react, generic: F.when(k % 3 == 0, next_).when(k % 3 == 1, react).otherwise(generic)
    end = lambda e: F.concat(F.lit("/c"), k, F.lit(e))
    path = of(F.concat(part("app/(g", 4, ")"), part("/[id", 5, "]"), end(".ts")), F.concat(part("src/__tests__/d", 6, ""), end(".test.tsx")), F.concat(part("app/[id", 5, "]"), end(".ts")))
    target = of(part("lib/@s", 7, "/m.ts"), part("src/__mocks__/m", 7, ".tsx"), part("lib/@s", 7, "/m.ts"))
    files = table(spark, sf_dir, "customer").select(of(F.lit("n"), F.lit("r"), F.lit("g")).alias("repo_id"), path.alias("path"), F.lit(None).cast("string").alias("text"), target.alias("target"))
    marks = files.select("repo_id").distinct().where("repo_id <> 'g'")
    marks = marks.select("repo_id", F.when(F.col("repo_id") == "n", "next.config.js").otherwise("package.json").alias("path"), F.when(F.col("repo_id") == "r", '{"dependencies": {"react": "1"}}').alias("text"), F.lit(None).cast("string").alias("target"))
    return files.unionByName(marks)

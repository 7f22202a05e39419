"""Imports, classes, exports, bindings and constructions from source texts, all in one pass over each file.

Input: sources (repo_id, path, text). A file is the unit of work: it is read in
Arrow batches and never leaves its task, and the facts are flat rows from which
the typed tables are projections, so persist facts() when several are needed.
Null texts and paths give no facts. Columns count bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators.lexer import END, Token, js_tokens, php_broken, php_tokens

SCHEMA = "repo_id string, file string, fact string, kind string, name string, other string, line int, column int, flag boolean"

# Statements are anchored at a line's start with the blank space before it, and their clause stays on one line.
STATEMENTS = {
    "import": re.compile(r"""^[\t\n\f\r ]*import(?:[\t\n\f\r ]+[^'\n;]*?[\t\n\f\r ]+from)?[\t\n\f\r ]*['"]([^'"]+)['"]""", re.M),
    "export_from": re.compile(r"""^[\t\n\f\r ]*export(?:[\t\n\f\r ]+[^'\n;]*?[\t\n\f\r ]+from)[\t\n\f\r ]*['"]([^'"]+)['"]""", re.M),
}
STRING = r""""(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?"""
JS_TOKEN = re.compile(STRING + r"|`(?:\\.|[^`\\])*`?|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
JS_CALL = re.compile(r"""(?<![\w$.])(?P<word>require|import)\s*\(\s*(?P<q>["'])(?P<raw>(?:\\.|(?!(?P=q))[^\\])*)(?P=q)\s*\)|""" + STRING + r"|`(?:\\.|[^`\\])*`?", re.S | re.A)
# A class after one of these is an expression, or abstract.
NOT_DECLARED = frozenset("= ( , : ? & | [ ! + * / < > - => . ?. return new extends abstract typeof await yield case throw void".split())
NOT_CONSTRUCTED = frozenset("this class super function import new".split())


def _blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def _text(s: str) -> str:
    return s.encode("latin-1").decode("utf-8", "replace")


def _without_comments(text: str) -> str:
    return JS_TOKEN.sub(lambda m: _blank(m.group()) if m.group()[0] == "/" else m.group(), text)


def _js_imports(shown: str) -> list[tuple[int, str, str]]:
    found = {(m.start(), kind, m.group(1)) for kind, rx in STATEMENTS.items() for m in rx.finditer(shown)}
    word = {"require": "require", "import": "dynamic_import"}
    found |= {(m.start(), word[m["word"]], m["raw"]) for m in JS_CALL.finditer(shown) if m["word"]}
    return sorted(found)


class _Reader:
    """Tokens with the ones around a place; past either end there is an empty one."""

    def __init__(self, tokens: Iterator[Token]):
        self.tokens = list(tokens)

    def __getitem__(self, k: int) -> Token:
        return self.tokens[k] if 0 <= k < len(self.tokens) else END

    def closed(self, k: int) -> int:
        """The place after the bracket that closes the one at k."""
        depth = 0
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == "sign":
                depth += (t.text in "([{") - (t.text in ")]}")
            k += 1
            if not depth:
                break
        return k

    def named(self, k: int) -> tuple[list[tuple[str, str]], int]:
        """(first, last) of the items `first as last` in the braces at k, and the place after them."""
        end = self.closed(k)
        items: list[list[str]] = [[]]
        for t in self.tokens[k + 1 : end - 1]:
            if t.text == ",":
                items.append([])
            elif t.kind in ("name", "string"):
                items[-1].append(t.text.strip("\"'"))
        words = [w[1:] if w[0] == "type" and len(w) in (2, 4) and w[1] != "as" else w for w in items if w]
        return [(w[0], w[-1]) for w in words], end


def _binding(r: _Reader, k: int) -> Iterator[tuple]:
    """Bindings of the import statement whose word is at k."""
    at, k = r[k].at, k + 1
    if r[k].kind == "string":
        yield "binding", "side_effect", None, r[k].text[1:-1], at, None
        return
    if r[k].text == "type" and r[k + 1].text != "," and (r[k + 1].text != "from" or r[k + 2].text == "from"):
        k += 1
    found: list[tuple[str, str]] = []
    while r[k].kind == "name" or r[k].text in (",", "*", "{"):
        if r[k].text == "{":
            items, k = r.named(k)
            found += [("named", f"{local} {imported}") for imported, local in items]
        elif r[k].text == "*" and r[k + 1].text == "as":
            found.append(("namespace", r[k + 2].text + " *"))
            k += 3
        elif r[k].text == "from" and r[k + 1].kind == "string":
            for kind, name in found:
                yield "binding", kind, name, r[k + 1].text[1:-1], at, None
            return
        elif r[k].kind == "name":
            found.append(("default", r[k].text + " default"))
            k += 1
        else:
            k += 1


def _export(r: _Reader, k: int, declared: set[str]) -> Iterator[tuple]:
    """Exports of the statement whose word is at k."""
    at, default = r[k].at, r[k + 1].text == "default"
    k += 1 + default
    if r[k].text == "class" and r[k + 1].kind == "name" and r[k + 1].text not in ("extends", "implements"):
        name = r[k + 1].text
        yield "export", None, "default" if default else name, name, at, name in declared
    elif default and r[k].kind == "name" and r[k].text not in ("class", "function", "abstract", "async", "new") and r[k + 1].text not in (".", "?.", "(", "[", "=>", "<", "`"):
        yield "export", None, "default", r[k].text, at, r[k].text in declared
    elif r[k].text == "{":
        items, k = r.named(k)
        if r[k].text != "from":
            for local, shown_as in items:
                yield "export", None, shown_as, local, at, local in declared


def js_facts(text: str, jsx: bool = True) -> Iterator[tuple]:
    """(fact, kind, name, other, offset, flag) of a script; text holds a character a byte."""
    for at, kind, raw in _js_imports(_without_comments(text)):
        yield "import", kind, raw.strip(), None, at, None
    r = _Reader(js_tokens(text, jsx))
    words: dict[str, list[int]] = {"class": [], "export": [], "import": [], "new": []}
    for k, t in enumerate(r.tokens):
        if t.kind == "name" and t.text in words and r[k - 1].text not in (".", "?."):
            words[t.text].append(k)
    declared = set()
    for k in words["class"]:
        if r[k + 1].kind == "name" and r[k + 1].text not in ("extends", "implements") and not (r[k - 1].kind in ("sign", "name") and r[k - 1].text in NOT_DECLARED):
            declared.add(r[k + 1].text)
            yield "class", None, r[k + 1].text, None, r[k].at, None
    for k in words["export"]:
        yield from _export(r, k, declared)
    for k in words["import"]:
        yield from _binding(r, k)
    for k in words["new"]:
        following = r[k + 1]
        if following.text in (".", ":", "?", "=", ",", ")", "}", ";", "<", "") or following.text == "(" and r[r.closed(k + 1)].text in (":", "=>"):
            continue  # a property, or the type of a constructor
        plain = following.kind == "name" and following.text not in NOT_CONSTRUCTED
        yield "new", None, following.text if plain else "", None, r[k].at, plain and r[k + 2].text not in (".", "[", "?.")


def _used(r: _Reader, k: int) -> Iterator[tuple]:
    """Imports of the use statement whose word is at k."""
    k += 1 + (r[k + 1].text.lower() in ("function", "const"))
    prefix = ""
    while r[k] is not END and r[k].text != ";":
        t = r[k]
        if r[k + 1].text == "{" and t.text.endswith("\\"):
            prefix = t.text.strip("\\")
            k += 1
        elif t.kind == "name" and r[k - 1].text.lower() != "as" and t.text.lower() not in ("as", "function", "const"):
            full = "\\".join(p for p in (prefix, t.text.strip("\\")) if p)
            if full:
                yield "import", "php_use", full, None, t.at, None
        k += 1


def _included(r: _Reader, k: int) -> Iterator[tuple]:
    """The first string of the expression after the word at k."""
    at, depth, k = r[k].at, 0, k + 1
    while r[k] is not END and r[k].text != ";" and depth >= 0:
        t = r[k]
        if t.kind == "string" and t.text[0] != "`":
            if t.text[1:-1].strip():
                yield "import", "php_include", t.text[1:-1], None, at, None
            return
        depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
        k += 1


def php_facts(text: str) -> Iterator[tuple]:
    """As js_facts, for PHP. A file that can be no PHP has a parse error and gives no other fact."""
    r = _Reader(php_tokens(text))
    if php_broken(r.tokens):
        yield "parse_error", None, None, None, 0, None
        return
    bodies: list[bool] = []  # for each open brace, whether a class body
    body = False
    for k, t in enumerate(r.tokens):
        word = t.text.lower() if t.kind == "name" and r[k - 1].text not in ("->", "?->", "::") else ""
        if word in ("class", "trait", "interface", "enum") and (r[k + 1].kind == "name" or r[k - 1].text.lower() == "new"):
            body = True
        elif t.text == "{":
            bodies.append(body)
            body = False
        elif t.text == "}" and bodies:
            bodies.pop()
        elif word == "use" and r[k + 1].text != "(" and not any(bodies):
            yield from _used(r, k)
        elif word in ("include", "include_once", "require", "require_once"):
            yield from _included(r, k)


TYPES = [pa.string()] * 6 + [pa.int32(), pa.int32(), pa.bool_()]


def file_facts(repo: str, path: str, source: str) -> Iterator[tuple]:
    """The facts of one file, as rows of SCHEMA."""
    text = source.encode("utf-8", "surrogatepass").decode("latin-1")
    low = path.lower()
    found = php_facts(text) if low.endswith((".php", ".phtml")) else js_facts(text, low.endswith((".tsx", ".jsx")))
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    for fact, kind, name, other, at, flag in found:
        line = bisect_right(lines, at)
        yield repo, path, fact, kind, name and _text(name), other and _text(other), line, at - lines[line - 1] + 1, flag


def _extract(batches: Iterator[pa.RecordBatch], most: int = 10000) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names)
    for batch in batches:
        rows: list[tuple] = []
        for repo, path, source in zip(*batch.columns, strict=True):
            if path.is_valid and source.is_valid:
                rows += file_facts(repo.as_py(), path.as_py(), source.as_py())
            if len(rows) >= most:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)


def facts(sources: DataFrame) -> DataFrame:
    return sources.select("repo_id", "path", "text").mapInArrow(_extract, SCHEMA)


def imports(found: DataFrame) -> DataFrame:
    """Imports as the resolver takes them, before resolution."""
    return found.where("fact = 'import'").select("repo_id", F.col("file").alias("source_file"), F.col("name").alias("raw_import"), F.lit(None).cast("string").alias("resolved_path"), F.lit(None).cast("boolean").alias("is_package"), "line", "column", "kind")


def classes(found: DataFrame) -> DataFrame:
    return found.where("fact = 'class'").select("repo_id", "file", "name", "line")


def exports(found: DataFrame) -> DataFrame:
    """Exported names of classes of the file."""
    return found.where("fact = 'export' and flag").select("repo_id", "file", F.col("name").alias("export_name"), F.col("other").alias("local_class"))


def bindings(found: DataFrame) -> DataFrame:
    """Names bound by imports; imported is 'default', '*' or the exported name, both null for imports without names."""
    return found.where("fact = 'binding'").select("repo_id", "file", F.col("other").alias("module"), F.substring_index("name", " ", 1).alias("local"), F.substring_index("name", " ", -1).alias("imported"), "kind", "line")


def constructions(found: DataFrame) -> DataFrame:
    return found.where("fact = 'new'").select("repo_id", "file", F.col("name").alias("class_name"), "line", "column", F.col("flag").alias("is_identifier"))


def parse_errors(found: DataFrame) -> DataFrame:
    return found.where("fact = 'parse_error'").select("repo_id", F.col("file").alias("path"))

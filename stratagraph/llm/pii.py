"""Personal data: exact base spans, and spans added by boosted trees, with DataFrame functions only.

Base spans are the leftmost non-overlapping matches of a pattern for each kind;
matches that fail the kind's check are dropped. The patterns are written with
possessive repeats and look-behinds that match the same strings in linear time.
Positions come from the text between matches: code points, end exclusive.

Candidates: high-recall generators propose runs of digits with separators,
numbers grouped like phones and cards, and spelled-out addresses; proposals
overlap each other. Each has format features (digits, groups, separators, check
digit, domain labels) and context features (the characters around it, and words
such as "call", "card" or "order" before it), in a few bins.

Boosted trees for each kind learn from weak labels. Positive are the base spans of
the kind. What sets base spans apart from other writings of the same data is hidden
from the trees: numbers are described without the country prefix that the base
pattern of phones asks for, and the sign between parts of an address and the
separators of cards and addresses of hosts are not features of these kinds. All other
candidates count as negative: base spans of other kinds, and proposals that touch
no base span. Some of the latter are data that no base pattern fits, so the share
of base spans among candidates that look alike is below 1 where such data occur.
A threshold for each kind is calibrated on the documents of a held-out fold: the
share where base spans are purest stands for certainty, and scores are taken from
the top as long as the share stays at `precision` of it and none of them falls
to half of it. A kind with a share under `floor` adds nothing.

Candidates that touch no base span become spans of the kind whose threshold they
pass by most; of overlapping ones that pass, the one that passes by most stays, then
the longest, then the first. Without enough base spans a kind adds none.

The trees are fitted on at most about `bound` documents, chosen by hash. Cells
beyond the `cells` most frequent ones are folded into coarser ones, none is left
out; the calibration counts the candidates of all held-out documents by score, and
scoring covers all documents and whole texts.

Null texts are empty and have no spans. Repeated rows and null ids get their
own rows. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm.common import cut, release, table

KINDS = ("email", "ip", "card", "phone")
# Same matches as the plain patterns: a match starts where a run starts, or where the last match ended in a run.
PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MAY = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?+[0-9]){12}", "phone": r"\+[0-9]"}
DIGIT_RUN = r"(?:\+|\()?[0-9](?:[ ().\[\]/_-]{0,3}+[0-9]){6,30}+"
SPELLED = r"[A-Za-z0-9._%+-]{1,64}+ ?+(?:@|\(at\)|\[at\]) ?+[A-Za-z0-9-]{1,64}+(?: ?+(?:\.|\(dot\)|\[dot\]) ?+[A-Za-z0-9-]{1,64}+){1,8}+"
PHONE_LIKE = r"(?:\+[0-9]{1,3}[ .-]?+)?+\(?+[0-9]{2,4}\)?+[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD_LIKE = r"(?<![0-9])[0-9]{4}(?:[ -]?+[0-9]{4}){3}(?![0-9])"
PREFIX = r"^\+(?:[0-9]{1,3}[ .-]+)?"
SPAN = "array<struct<start:int,end:int,value:string>>"
PAGE = 1024
DIGITS = 3  # of a score after the point, so that there are few different ones
FEATURES = ("digits", "groups", "first", "last", "separator", "open", "luhn", "octets", "labels", "ending", "before", "after", "word", "spelled")
#: Features that tell base spans of a kind from other writings of it.
OWN = {"email": ("spelled", "separator"), "ip": ("separator",), "card": ("separator",), "phone": ()}
#: Features that folded cells keep; digits in fours.
COARSE = ("groups", "separator", "luhn", "octets", "word", "spelled")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.reverse(digits(value))
    number = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    doubled = lambda n: F.when(n > 4, n * 2 - 9).otherwise(n * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(number(i))).otherwise(number(i)))
    return (F.length(d) > 0) & (total % 10 == 0)


def octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def holds(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    return {"email": F.lit(True), "ip": octets(value), "card": n.between(13, 19) & luhn(value), "phone": n.between(9, 15)}[kind]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def scanned(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, size: int = 256) -> Column:
    """A fold over items: step(state, item) is the new state and an array of new elements of type kind; gives (state, out).

    An array that grows is copied at every append, so elements are first appended in
    parts of size items, and the parts are joined at the end.
    """
    parts = bound(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.size(x) - 1) / size).cast("int")), lambda i: F.slice(x, i * size + 1, size)))
    none = F.array().cast(f"array<{kind}>").alias("out")

    def over(acc: Column, part: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            after, new = step(a["state"], x)
            return F.struct(after.alias("state"), F.concat(a["out"], new).alias("out"))

        return F.aggregate(part, F.struct(acc["state"].alias("state"), none), one, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(parts, start, over, lambda r: F.struct(r["state"].alias("state"), F.flatten(r["out"]).alias("out")))


#: The generators of proposals, with what a text must hold for them.
PROPOSE = {DIGIT_RUN: "[0-9]", PHONE_LIKE: "[0-9]", CARD_LIKE: "[0-9]", SPELLED: r"@|\(at\)|\[at\]"}
FOUND = "struct<of:int,start:int,end:int,value:string>"


def found(text: Column, proposed: bool = True) -> Column:
    """Spans of all kinds that hold, `of` being the kind's number, and of all generators' proposals, of a number past those; one fold over the matches of all patterns: the text between matches gives their places."""
    patterns = [(PATTERN[k], MAY[k]) for k in KINDS] + list(PROPOSE.items()) * proposed

    def located(i: int, pattern: str) -> Column:
        gaps = lambda m: F.slice(F.split(text, pattern, -1), 1, F.size(m))
        tagged = lambda m, g: F.struct(F.lit(i).alias("of"), m.alias("m"), F.char_length(g).alias("g"))
        return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.zip_with(m, gaps(m), tagged))

    items = [F.when(text.rlike(may), located(i, pattern)).otherwise(F.array().cast("array<struct<of:int,m:string,g:int>>")) for i, (pattern, may) in enumerate(patterns)]

    def step(state: Column, p: Column) -> tuple[Column, Column]:
        begin = F.when(state["of"] == p["of"], state["at"]).otherwise(0) + p["g"]
        keep = F.lit(True)
        for i, k in enumerate(KINDS):
            if k != "email":
                keep = F.when(p["of"] == i, holds(k, p["m"])).otherwise(keep)
        span = bound(begin, lambda at: F.array(F.struct(p["of"].alias("of"), at.alias("start"), (at + F.char_length(p["m"])).alias("end"), p["m"].alias("value"))))
        return F.struct(p["of"].alias("of"), (begin + F.char_length(p["m"])).alias("at")), F.when(keep, span).otherwise(F.array().cast(f"array<{FOUND}>"))

    return scanned(F.concat(*items), F.struct(F.lit(-1).alias("of"), F.lit(0).alias("at")), step, FOUND)["out"]


def spans_by(wanted: Callable[[Column], Column], found_: str = "found") -> Column:
    """The spans of found whose number is wanted."""
    return F.transform(F.filter(found_, lambda s: wanted(s["of"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def base_columns() -> list[Column]:
    return [spans_by(lambda of, i=i: of == i).alias(k) for i, k in enumerate(KINDS)]


def free(proposed: Column, base: Column) -> Column:
    """The proposed spans, each once, that overlap none of base: the furthest end of base spans that start before a span's end is not past its start."""
    points = lambda spans, key, late: F.transform(spans, lambda s: F.struct(s[key].alias("key"), F.lit(late).alias("late"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    items = F.sort_array(F.concat(points(base, "start", 1), points(proposed, "end", 0)))
    start = F.struct(F.lit(0).alias("reach"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        of_base = x["late"] == 1
        after = F.struct(F.when(of_base, F.greatest(state["reach"], x["end"])).otherwise(state["reach"]).alias("reach"), F.when(of_base, state["start"]).otherwise(x["start"]).alias("start"), F.when(of_base, state["end"]).otherwise(x["end"]).alias("end"))
        new = ~of_base & (state["reach"] <= x["start"]) & ((state["start"] != x["start"]) | (state["end"] != x["end"]))
        return after, F.when(new, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))).otherwise(F.array().cast(SPAN))

    return F.when(F.size(items) > 0, scanned(items, start, step, SPAN[6:-1])["out"]).otherwise(F.array().cast(SPAN))


def in_pages(text: Column) -> Column:
    """The text in pages of PAGE code points, so that a place is found without counting from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def excerpt(pages: Column, at: Column, n: Column) -> Column:
    """n code points from place at; empty where they lie outside."""
    first, last = F.floor(at / PAGE).cast("int"), F.floor((at + n - 1) / PAGE).cast("int")
    page = lambda i: F.coalesce(F.get(pages, i), F.lit(""))
    whole = F.array_join(F.slice(pages, first + 2, F.greatest(F.lit(0), last - first - 1)), "")
    head = F.substring(page(first), at - first * PAGE + 1, n)
    return F.when(n <= 0, "").when(last == first, head).otherwise(F.concat(head, whole, F.substring(page(last), F.lit(1), at + n - last * PAGE)))


def near(pages: Column, at: Column, n: int) -> Column:
    """Up to n code points from place at, n at most PAGE."""
    return bound(F.floor(at / PAGE).cast("int"), lambda i: F.substring(F.concat(F.get(pages, i), F.coalesce(F.get(pages, i + 1), F.lit(""))), at - i * PAGE + 1, F.lit(n)))


def described(pages: Column, s: Column) -> Column:
    """Features of a span (start, end, value) of a text in pages, its value without a country prefix. What several features read is computed once."""
    v = F.regexp_replace(s["value"], PREFIX, "")
    start = F.greatest(F.lit(0), s["start"] - 24)
    past = F.lower(F.substring(near(pages, start, 24), F.lit(1), s["start"] - start))
    ends = F.array(F.when(s["start"] > 0, near(pages, s["start"] - 1, 1)).otherwise(""), F.coalesce(near(pages, s["end"], 1), F.lit("")))
    kind = lambda c: F.when(c == "", 0).when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\s"), 3).when(c.rlike("[,.;:!?)]"), 4).otherwise(5)
    word = bound(past, lambda p: F.when(p.rlike("order|invoice|ticket|item|part|serial|account|token|version"), 5).when(p.rlike("phone|tel|call|fax|mobil"), 1).when(p.rlike("card|visa|credit|iban"), 2).when(p.rlike("host|addr|server"), 3).when(p.rlike("mail|contact|write"), 4).otherwise(0))

    def features(b: Column) -> Column:
        v, group, domain = b["v"], b["group"], b["domain"]
        size = lambda i: F.least(F.lit(7), F.coalesce(F.length(F.try_element_at(group, F.lit(i))), F.lit(0)))
        found = {
            "digits": F.least(F.lit(20), F.length(digits(v))),
            "groups": F.least(F.lit(7), F.size(group)),
            "first": size(1),
            "last": size(-1),
            "separator": F.when(v.rlike("[()]"), 4).when(v.rlike(r"\."), 3).when(v.rlike("-"), 2).when(v.rlike(" "), 1).otherwise(0),
            "open": v.startswith("("),
            "luhn": luhn(v),
            "octets": (F.size(group) == 4) & F.forall(group, lambda g: octets(g)),
            "labels": F.when(domain == "", 0).otherwise(F.least(F.lit(5), F.size(F.split(domain, r"\.|\(dot\)|\[dot\]")))),
            "ending": F.when(domain == "", 0).otherwise(F.least(F.lit(7), F.length(F.regexp_extract(domain, "([A-Za-z]*)$", 1)))),
            "before": b["around"][0],
            "after": b["around"][1],
            "word": b["word"],
            "spelled": F.when(v.contains("@"), 1).when(v.rlike(r"\((?:at|dot)\)|\[(?:at|dot)\]"), 2).otherwise(0),
        }
        return F.struct(*(c.cast("int").alias(n) for n, c in found.items()))

    parts = lambda v: F.struct(v.alias("v"), F.filter(F.split(v, "[^0-9]+"), lambda g: g != "").alias("group"), F.regexp_extract(v, r"(?:@|\(at\)|\[at\])(.*)$", 1).alias("domain"), F.transform(ends, kind).alias("around"), word.alias("word"))
    return bound(bound(v, parts), features)


@dataclass
class Trees:
    """Boosted trees of one kind: nested (feature, bound, left, right), a leaf is a number; and the threshold on their sum."""

    trees: list
    threshold: float


def grow(rows: list, features: list[int], depth: int) -> tuple | float:
    """A regression tree on (cell, gradient, hessian) rows by Newton gain."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = -g / (h + 1.0)
    if depth == 0:
        return leaf
    best = (1e-6, None)
    for f in features:
        at: dict[int, list[float]] = {}
        for cell, a, b in rows:
            x = at.setdefault(cell[f], [0.0, 0.0])
            x[0] += a
            x[1] += b
        lg = lh = 0.0
        for value in sorted(at)[:-1]:
            lg, lh = lg + at[value][0], lh + at[value][1]
            gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, (f, value))
    if best[1] is None:
        return leaf
    f, value = best[1]
    return f, value, grow([r for r in rows if r[0][f] <= value], features, depth - 1), grow([r for r in rows if r[0][f] > value], features, depth - 1)


def value_of(tree: tuple | float, cell: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if cell[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(cells: list[tuple[tuple, float, float]], features: list[int], rounds: int = 12, depth: int = 3, rate: float = 0.5) -> list:
    """Logistic boosting on (cell, positives, all)."""
    score, trees = [0.0] * len(cells), []
    for _ in range(rounds):
        rows = []
        for (cell, pos, n), s in zip(cells, score, strict=True):
            p = 1 / (1 + math.exp(-s))
            rows.append((cell, n * p - pos, n * p * (1 - p)))
        tree = grow(rows, features, depth)
        scale = lambda t: (t[0], t[1], scale(t[2]), scale(t[3])) if isinstance(t, tuple) else rate * max(-4.0, min(4.0, t))
        trees.append(scale(tree))
        score = [s + value_of(trees[-1], cell) for (cell, _, _), s in zip(cells, score, strict=True)]
    return trees


def calibrated(scores: list[tuple[float, float, float]], precision: float, least: float, floor: float) -> float:
    """The lowest score that held-out candidates, given as (score, positives, all), allow; infinite if none. See above."""
    scores = sorted(scores, reverse=True)
    total = sum(a for _, a, _ in scores)
    pos = n = best = 0.0
    for _, a, b in scores:
        pos, n = pos + a, n + b
        if pos >= max(least, total / 2):
            best = max(best, pos / n)
    if best < floor:
        return math.inf
    found, pos, n, p, m = math.inf, 0.0, 0.0, 0.0, 0.0
    for s, a, b in scores:
        pos, n, p, m = pos + a, n + b, p + a, m + b
        if pos < precision * best * n - 2 * math.sqrt(n * best * (1 - best)):
            break
        if p > best * m / 2:
            p = m = 0.0
            found = s if pos >= least else found
    return found


def _held() -> Column:
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0, F.lit(False))


def candidate_cells(docs: DataFrame) -> DataFrame:
    """Counts of candidates by features and kind; the kind is empty for proposals that touch no base span."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", t.alias("t")).where(F.col("t").rlike(r"[0-9@]|\(at\)|\[at\]"))
    d = d.select("t", found(F.col("t")).alias("found"))
    d = d.select(*base_columns(), spans_by(lambda of: of >= len(KINDS)).alias("proposed"), in_pages(F.col("t")).alias("pages"))
    d = d.select(*KINDS, free(F.col("proposed"), F.concat(*KINDS)).alias("free"), "pages")
    named = lambda kind: lambda s: F.struct(s.alias("s"), F.lit(kind).alias("kind"))
    every = F.concat(F.transform("free", named("")), *(F.transform(k, named(k)) for k in KINDS))
    made = d.select(F.inline(F.transform(every, lambda x: F.struct(described(F.col("pages"), x["s"]).alias("f"), x["kind"].alias("kind"))))).select("f.*", "kind")
    return made.groupBy(*FEATURES, "kind").agg(F.count(F.lit(1)).alias("n"))


def fitted(docs: DataFrame, bound: int = 20000, cells: int = 20000, precision: float = 0.98, least: int = 20, floor: float = 0.25) -> dict[str, Trees]:
    n = docs.count()
    share = max(1, round((1 << 30) * min(1.0, bound / max(n, 1))))
    sample = docs.where(F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(1 << 30)) < share)
    every = cut(candidate_cells(sample.where(~_held())), "cells")
    key = [*FEATURES, "kind"]
    rows = every.orderBy(F.desc("n"), *key).limit(cells).collect()
    if len(rows) == cells:
        last = rows[-1]["n"]  # of the cells as frequent as the last one, all are folded
        rows = [r for r in rows if r["n"] > last]
        coarse = [(F.floor(F.col(f) / 4) * 4).cast("int").alias(f) if f == "digits" else F.col(f) if f in COARSE else F.lit(0).alias(f) for f in FEATURES]
        rows += every.where(F.col("n") <= last).groupBy(*coarse, "kind").agg(F.sum("n").alias("n")).collect()
    release(every)
    trees = {}
    for kind in KINDS:
        features = [i for i, f in enumerate(FEATURES) if f not in OWN[kind]]
        data: dict[tuple, list[float]] = {}
        for r in rows:
            x = data.setdefault(tuple(r[f] for f in FEATURES), [0.0, 0.0])
            x[0] += r["n"] * (r["kind"] == kind)
            x[1] += r["n"]
        if sum(a for a, _ in data.values()) >= least:
            trees[kind] = boost([(c, a, b) for c, (a, b) in sorted(data.items())], features)
    scores: dict[str, list[tuple[float, float, float]]] = {k: [] for k in trees}
    if trees:
        f = {n: F.col(n) for n in FEATURES}
        scored = [F.struct(F.lit(k).alias("of"), F.round(_score(t, f), DIGITS).alias("score"), F.when(F.col("kind") == k, F.col("n")).otherwise(0).alias("pos"), F.col("n").alias("n")) for k, t in trees.items()]
        counts = candidate_cells(docs.where(_held())).select(F.inline(F.array(*scored))).groupBy("of", "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
        for r in counts.collect():
            scores[r["of"]].append((r["score"], r["pos"], r["n"]))
    return {k: Trees(trees[k], calibrated(scores[k], precision, least / 4, floor)) if k in trees else Trees([], math.inf) for k in KINDS}


def _expression(tree: tuple | float, f: dict[str, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(f[FEATURES[tree[0]]] <= tree[1], _expression(tree[2], f)).otherwise(_expression(tree[3], f))


def _score(trees: list, f: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for tree in trees:
        total = total + _expression(tree, f)
    return total


def _margin(trees: Trees, x: Column) -> Column:
    """The sum of the trees above the threshold, by the sum that the threshold was calibrated on."""
    return F.round(_score(trees.trees, {n: x[n] for n in FEATURES}), DIGITS) - F.lit(float(trees.threshold))


PASSED = "struct<start:int,end:int,value:string,kind:string,m:double,beaten:boolean>"


def unbeaten(passing: Column) -> Column:
    """The spans that pass and overlap no other one that passes by more, or by as much and is longer, or as long and earlier. Spans are met by start and stay in the state until none that comes can overlap them, a few of each generator."""
    size = lambda s: s["end"] - s["start"]
    more = lambda y, x: (y["m"] > x["m"]) | ((y["m"] == x["m"]) & ((size(y) > size(x)) | ((size(y) == size(x)) & (y["start"] < x["start"]))))
    marked = lambda y, beaten: F.struct(*(y[c].alias(c) for c in ("start", "end", "value", "kind", "m")), beaten.alias("beaten"))

    def step(live: Column, x: Column) -> tuple[Column, Column]:
        near = F.filter(live, lambda y: y["end"] > x["start"])
        after = F.concat(F.transform(near, lambda y: marked(y, y["beaten"] | more(x, y))), F.array(marked(x, F.exists(near, lambda y: more(y, x)))))
        return after, F.filter(live, lambda y: (y["end"] <= x["start"]) & ~y["beaten"])

    found = scanned(F.sort_array(passing), F.array().cast(f"array<{PASSED}>"), step, PASSED)
    return bound(found, lambda r: F.concat(r["out"], F.filter(r["state"], lambda y: ~y["beaten"])))


def _named(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])


def _typed(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def with_spans(docs: DataFrame, trees: dict[str, Trees]) -> DataFrame:
    """docs with _base_<kind> and _all_<kind>, arrays of (start, end, value) in order of start; columns of these names are replaced."""
    t = F.col("t")
    d = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    active = [k for k in KINDS if trees[k].trees and trees[k].threshold < math.inf]
    d = d.select("doc", "t", found(t, bool(active)).alias("found"))
    d = d.select("doc", "t", *base_columns(), spans_by(lambda of: of >= len(KINDS)).alias("proposed"))
    if active:
        d = d.select("doc", *KINDS, free(F.col("proposed"), F.concat(*KINDS)).alias("free"), F.when(F.size("proposed") > 0, in_pages(t)).alias("pages"))
        margins = F.transform("free", lambda s: bound(described(F.col("pages"), s), lambda x: F.struct(s.alias("s"), F.greatest(*(F.struct(_margin(trees[k], x).alias("m"), F.lit(k).alias("kind")) for k in active), F.struct(F.lit(-1.0).alias("m"), F.lit("").alias("kind"))).alias("best"))))
        passing = F.filter(margins, lambda x: x["best"]["m"] >= 0)
        flat = F.transform(passing, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["value"].alias("value"), x["best"]["kind"].alias("kind"), x["best"]["m"].alias("m")))
        d = d.select("doc", *KINDS, F.when(F.size("free") > 0, flat).alias("passing"))
        d = d.select("doc", *KINDS, F.when(F.size("passing") > 0, unbeaten(F.col("passing"))).alias("new"))
        of = lambda k: F.transform(F.filter("new", lambda x: x["kind"] == k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
        every = {k: F.when(F.coalesce(F.size("new"), F.lit(0)) > 0, F.sort_array(F.concat(k, of(k)))).otherwise(F.col(k)) if k in active else F.col(k) for k in KINDS}
    else:
        every = {k: F.col(k) for k in KINDS}
    taken = [f"_{a}_{k}" for a in ("base", "all") for k in KINDS]
    return d.select(*(F.col("doc")[c].alias(c) for c in docs.columns if c not in taken), *(F.col(k).alias(f"_base_{k}") for k in KINDS), *(every[k].alias(f"_all_{k}") for k in KINDS))


def shown(prefix: str) -> Column:
    """kind:start:end of all spans, by kind, then start."""
    return F.array_join(F.concat(*(F.transform(f"{prefix}{k}", _named(k)) for k in KINDS)), ",")


def redacted(docs: DataFrame, trees: dict[str, Trees]) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; of overlapping spans the union goes, under the first's kind."""
    d = with_spans(docs.select(F.struct("*").alias("doc"), "text"), trees)
    spans = F.sort_array(F.concat(*(F.transform(f"_all_{k}", _typed(k)) for k in KINDS)))
    text = F.col("text").cast("string")

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.concat(excerpt(F.col("_pages"), at, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.array(gap)).otherwise(F.array().cast("array<string>"))

    d = d.withColumn("_spans", spans).withColumn("_pages", F.when(F.size("_spans") > 0, in_pages(text)))
    cut_ = scanned(F.col("_spans"), F.lit(0), step, "string")
    new = bound(cut_, lambda r: F.concat(F.array_join(r["out"], ""), excerpt(F.col("_pages"), r["state"], F.char_length(text) - r["state"])))
    new = F.when(F.size("_spans") > 0, new).otherwise(text)
    return d.select(*(new.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = with_spans(docs, fitted(docs))
    return d.select("doc_id", *(F.size(f"_base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(shown("_base_"), 256).alias("base_sha256"), shown("_all_").alias("spans"))

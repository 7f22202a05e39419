"""Tokens of script and PHP texts, by scanners with a stack of modes.

A mode says what the text at a place can hold: code, a template's text, a JSX tag or
what stands between JSX tags; for PHP code, text outside its tags, and interpolated
strings. What begins a nested mode is pushed and what ends it is popped, so quotes,
braces and slashes mean what they mean where they stand. Tokens are (kind, text, offset),
kinds "name", "value" (numbers, strings, regular expressions, templates and elements), "string" and
"sign"; comments and blank space give none. Each character is read a bounded number of
times. A text holds a character a byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Token(NamedTuple):
    kind: str
    text: str
    at: int


END = Token("end", "", -1)
QUOTED = r"'(?:[^'\\\n]|\\.)*+'?|\"(?:[^\"\\\n]|\\.)*+\"?"
JS = re.compile(rf"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|(?P<value>\.?[0-9](?:[\w.]|(?<=[eE])[+-])*)|(?P<string>{QUOTED})|(?P<sign>=>|\.\.\.|\+\+|--|\?\.(?![0-9])|.)", re.S | re.A)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\\\Z|\$(?!\{))*+(`|\$\{|\Z)", re.S)
TAG = re.compile(r"<(?:(?P<name>[A-Za-z_$][\w$.:-]*)(?=[\s/>{<])(?!\s*,|\s+extends\b)|(?P<none>>))", re.A)
IN_TAG = re.compile(r"""[^{}"'<>/]+|"[^"]*"?|'[^']*'?|/>|.""", re.S)
BETWEEN = re.compile(r"[^<{]*+(</[^>]*>?|<|\{|\Z)")
#: Names that an expression follows, so that a slash or a less-than sign after them begins one.
BEFORE_EXPRESSION = frozenset("return typeof instanceof in of new delete void throw case do else await yield default extends".split())
CONDITION = frozenset(("if", "while", "for", "with"))


def js_tokens(text: str, jsx: bool) -> Iterator[Token]:
    """Tokens of a script. Code in templates, attributes and elements gives tokens of its own."""
    at, last, n = 0, END, len(text)
    modes: list[tuple[str, bool]] = []  # each with what it tells: for braces whether a block, for parentheses whether a condition, for tags whether they close
    ended = False  # whether a value has just ended
    closing: dict[str, int] = {}

    def element(m: re.Match) -> bool:
        """Whether what looks like a tag is closed later on; else it is a type argument."""
        wanted = ["</" + (m["name"] or ">")] + ["/>"] * (text[m.end() : m.end() + 1] != ">" and not m["none"])
        return any(closing.setdefault(x, text.rfind(x)) > at for x in wanted)

    while at < n:
        mode = modes[-1][0] if modes else "{"
        if mode == "`":
            m = TEMPLATE.match(text, at)
            at = m.end()
            modes.pop()
            if m[1] == "${":
                modes += [("`", False), ("{", False)]
                ended = False
                last = Token("sign", "${", at - 2)
            else:
                ended = True
            continue
        if mode == "<":  # within a tag
            m = IN_TAG.match(text, at)
            at = m.end()
            if m[0] == "{":
                modes.append(("{", False))
                ended, last = False, Token("sign", "{", at - 1)
            elif m[0] == "<":  # type arguments of a tag
                modes.append(("<>", False))
            elif m[0] == "/>":
                modes.pop()
                ended = True
            elif m[0] == ">":
                modes[-1] = (">", False)
            continue
        if mode == "<>":
            at += 1
            if text[at - 1] == ">":
                modes.pop()
            continue
        if mode == ">":  # between tags
            m = BETWEEN.match(text, at)
            at = m.end()
            if m[1] == "{":
                modes.append(("{", False))
                ended, last = False, Token("sign", "{", at - 1)
            elif m[1].startswith("</"):
                modes.pop()
                ended = True
            elif m[1] == "<":
                modes.append((">", False) if text.startswith(">", at) else ("<", False))
                at += text.startswith(">", at)
            continue
        c = text[at]
        if c == "`":
            yield (last := Token("value", "`", at))
            modes.append(("`", False))
            at += 1
            continue
        if c == "/" and not ended and (m := REGEX.match(text, at)):
            yield (last := Token("value", "/", at))
            at, ended = m.end(), True
            continue
        if c == "<" and jsx and not ended and (m := TAG.match(text, at)) and element(m):
            yield (last := Token("value", "<", at))
            modes.append((">", False) if m["none"] else ("<", False))
            at = m.end()
            continue
        m = JS.match(text, at)
        start, at = at, m.end()
        if m["skip"] is not None:
            continue
        t = Token(m.lastgroup, m[0], start)
        if c in "({[":
            block = last is END or last.text in (")", ";", "{", "}", "=>", "else", "do", "try", "finally") if c == "{" else last.text in CONDITION
            modes.append((c, block))
            ended = False
        elif c in ")}]":
            block = False
            if modes and modes[-1][0] == {")": "(", "}": "{", "]": "["}[c]:
                block = modes.pop()[1]
            ended = not block
            if modes and modes[-1][0] in ("`", "<", ">") and c == "}":
                last = t
                continue
        elif t.kind == "name":
            ended = t.text not in BEFORE_EXPRESSION or last.text in (".", "?.")
        else:
            ended = t.kind in ("value", "string") or t.text in ("++", "--") and ended
        yield t
        last = t


HTML_END = re.compile(r".*?(?:<\?(?:php\b|=|(?=\s))|\Z)", re.S)
PHP = re.compile(
    r"(?P<skip>\s+|(?://|\#(?!\[))(?:(?!\?>)[^\n])*|/\*.*?\*/)|(?P<open>/\*)|(?P<html>\?>)|(?P<doc><<<[ \t]*(?P<q>[\"']?)(?P<label>[A-Za-z_\x80-\xff][\w\x80-\xff]*)(?P=q)\r?\n)"
    r"|(?P<variable>\$+[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<name>\\?[A-Za-z_\x80-\xff][\w\x80-\xff]*(?:\\[A-Za-z_\x80-\xff][\w\x80-\xff]*)*(?:\\(?=\{))?)|(?P<value>\.?[0-9](?:\w|\.(?![.])|(?<=[eE])[+-])*)"
    r"|(?P<string>'(?:[^'\\]|\\.)*+')|(?P<cast>\([ \t]*(?:int|integer|bool|boolean|float|double|real|string|array|object|binary|unset)[ \t]*\))"
    r"|(?P<sign>\#\[|\?->|->|::|=>|\.\.\.|\+\+|--|<=>|\*\*=|\?\?=|<<=|>>=|===|!==|==|!=|<>|<=|>=|&&|\|\||\?\?|\*\*|<<|>>|[-+*/.%&|^]=|.)",
    re.S | re.I,
)
INTERPOLATED = {q: re.compile(rf"(?:[^{q}\\{{]|\\.|\\\Z|\{{(?!\$))*+({q}|\{{(?=\$)|\Z)", re.S) for q in '"`'}


def php_tokens(text: str) -> Iterator[Token]:
    """Tokens of PHP code; "?>" ends a statement and gives ";". What is not closed gives a token of kind "error". Strings with interpolations are one token, and code in them gives none."""
    at, n = HTML_END.match(text).end(), len(text)
    while at < n:
        c = text[at]
        if c in '"`':
            start, depth = at, 0
            at += 1
            while True:
                m = INTERPOLATED[c].match(text, at)
                at = m.end()
                if m[1] == c:
                    break
                if m[1] == "":
                    yield Token("error", "", start)
                    return
                at = _skip_braces(text, at)
            yield Token("string", text[start:at], start)
            continue
        m = PHP.match(text, at)
        start, at = at, m.end()
        if m["skip"] is not None:
            continue
        if m["html"]:
            yield Token("sign", ";", start)
            at = HTML_END.match(text, at).end()
            continue
        if m["doc"]:
            close = re.compile(rf"^[ \t]*{re.escape(m['label'])}\b", re.M).search(text, at)
            if not close:
                yield Token("error", "", start)
                return
            at = close.end()
            yield Token("value", "<<<", start)
            continue
        if m["open"] or c == "'" and not m["string"]:
            yield Token("error", "", start)
            return
        yield Token("value" if m.lastgroup == "variable" else m.lastgroup, m[0], start)


def _skip_braces(text: str, at: int) -> int:
    """The end of the code in braces that ends at the brace that closes the one before at; the text's end if none does."""
    depth = 1
    brace = re.compile(r"'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\"|[{}]", re.S)
    while m := brace.search(text, at):
        at = m.end()
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return at
    return len(text)


#: Fixed words and signs of the language.
ALTERNATIVE = {"endif": "if", "endwhile": "while", "endfor": "for", "endforeach": "foreach", "endswitch": "switch", "enddeclare": "declare"}
NEEDS_PARENTHESIS = frozenset(["elseif", "catch", *ALTERNATIVE.values()])
STATEMENT = frozenset("return echo if while switch for foreach do try break continue global unset interface trait abstract final public protected private goto".split())
OTHER_WORDS = frozenset("new clone print case default else yield static function fn use const include include_once require require_once extends implements var namespace class match finally throw".split())
INFIX_WORDS = frozenset("instanceof and or xor as insteadof".split())
INFIX = frozenset("= == === != !== <> < > <= >= <=> + - * / % . ** && || ?? -> ?-> :: => & | ^ << >> += -= *= /= .= %= **= ??= &= |= ^= <<= >>=".split())
PREFIX = frozenset("+ - & ! ~ @ ++ -- ... ?".split())
PAIRS = {")": "(", "]": "[", "}": "{"}


class Item(NamedTuple):
    """A token by its part in a sentence: operand, name (an operand that a variable may follow, as a type), word, infix, prefix, postfix, open, close, sign, error or end."""

    part: str
    text: str

    @property
    def ends_value(self) -> bool:
        return self.part in ("operand", "name", "postfix") or self.part == "close" and self.text != "}"


def php_items(tokens: list[Token]) -> Iterator[Item]:
    last = Item("sign", ";")
    for k, t in enumerate(tokens):
        after = tokens[k + 1].text if k + 1 < len(tokens) else ""
        low = t.text.lower()
        if t.kind in ("value", "string"):
            item = Item("operand", "")
        elif t.kind == "cast":
            item = Item("prefix", "!")
        elif t.kind == "name":
            label = after == ":" and last.text in ("(", ",")
            plain = low == "class" and last.text in ("new", "readonly") or last.text in ("->", "?->", "::", "function", "const") or label or low not in STATEMENT | OTHER_WORDS | NEEDS_PARENTHESIS | ALTERNATIVE.keys() | INFIX_WORDS
            item = Item("name", t.text) if plain else Item("infix" if low in INFIX_WORDS else "word", low)
        elif t.kind == "error":
            item = Item("error", "")
        elif low in ("++", "--"):
            item = Item("postfix" if last.ends_value else "prefix", low)
        elif low in ("(", "[", "{", "#["):
            item = Item("open", low)
        elif low in PAIRS:
            item = Item("close", low)
        elif low in INFIX and (last.ends_value or low not in PREFIX):
            item = Item("infix", low)
        else:
            item = Item("prefix" if low in PREFIX else "sign", low)
        yield item
        last = item
    yield Item("end", "")


def misplaced(last: Item, x: Item) -> bool:
    """Whether no PHP has x right after last."""
    if x.part == "error":
        return True
    if last.part in ("infix", "prefix") and last.text not in ("&", "...", "=>", "?") and (x.part in ("close", "end") or x.text in (";", ",")):
        return True  # an operator without what it is for
    if x.part == "infix" and x.text not in ("&", "=>", "::") and not last.ends_value and not (last.text == "}" and x.text in ("->", "?->")):
        return last.part != "word" or x.text not in ("=", "::", "|")
    if last.part == "operand" and (x.part in ("operand", "name", "word") or x.text == "{" and x.part == "open"):
        return True  # nothing between two values
    if last.ends_value and x.part == "word" and x.text in STATEMENT:
        return last.part != "close"  # a statement that begins in another, but for the body of a condition
    if last.part != "word":
        return False
    if last.text in NEEDS_PARENTHESIS and x.text != "(":
        return True
    if last.text in ("interface", "trait") and x.part != "name" or last.text == "class" and x.part != "name":
        return True
    if last.text == "use" and not (x.part == "name" or x.text in ("(", "function", "const")) or last.text == "new" and not (x.part in ("name", "operand", "open") or x.text in ("class", "static")):
        return True
    return last.text in ("else", "do", "try", "echo", "case", "global", "extends", "implements", "include", "require", "include_once", "require_once") and (x.part in ("close", "end", "infix") or x.text in (",", ";"))


class Nesting:
    """Brackets and alternative blocks that are open. A parenthesis remembers the word before it, a brace whether it holds statements."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str]] = []
        self.head = ""  # the word before the parenthesis that has just closed

    def broken(self, last: Item, x: Item) -> bool:
        """Takes x and tells whether it cannot stand here."""
        top, of = self.open[-1] if self.open else ("", "")
        if x.part == "open":
            inner = last.text in ("->", "?->", "::", "$") or last.text.endswith("\\") or last.text == ")" and self.head == "match"
            self.open.append(("[" if x.text == "#[" else x.text, last.text if last.part == "word" and x.text == "(" else "value" if inner else ""))
        elif x.part == "close":
            if top != PAIRS[x.text]:
                return True
            self.open.pop()
            self.head = of if x.text == ")" else ""
            if x.text == "}" and not of:
                return last.ends_value or last.text in ("return", "break", "continue", "echo")
            return last.text == ";" and of != "for"
        elif x.text == ";" and x.part == "sign":
            return top in ("(", "[") and of != "for" or of == "value"
        elif x.text == ":" and last.text == ")" and self.head in ALTERNATIVE.values() and top != "(":
            self.open.append((self.head, ""))
        elif x.text == ":" and (last.text == "else" or last.text == ")" and self.head == "elseif"):
            return top != "if"
        elif x.part == "word" and x.text in ALTERNATIVE:
            if top != ALTERNATIVE[x.text]:
                return True
            self.open.pop()
        elif x.part == "end":
            return bool(self.open) or last.ends_value or last.part == "word" and last.text in STATEMENT
        return False


def php_broken(tokens: list[Token]) -> bool:
    """Whether tokens can be no PHP, by what may follow what and by what is open."""
    nesting, last = Nesting(), Item("sign", ";")
    for x in php_items(tokens):
        if misplaced(last, x) or nesting.broken(last, x):
            return True
        last = x
    return False

"""Tokens of Java and JavaScript source: strings, templates, comments, regular expressions and brackets told apart.

No grammar: just enough to say what is code and what isn't, which brackets belong together, and which
words begin a statement at the top.  JavaScript covers JSX but for quotes and slashes in its plain text.
Positions are bytes; a source is read as Latin-1, so that each byte is a character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, string, template, regex, open, close, mark
    text: str
    start: int
    end: int
    depth: int  # of brackets around it; an opening bracket and its closing one have the same


_WORD = r"(?P<word>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|(?P<number>\.?\d[\w.]*)"
_SKIP = r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
_SCANNERS = {
    "java": re.compile(rf'{_SKIP}|(?P<string>"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|{_WORD}|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<mark>.)', re.DOTALL),
    "javascript": re.compile(rf'{_SKIP}|(?P<string>"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|{_WORD}|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<mark>=>|.)', re.DOTALL),
}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.DOTALL)
#: Words after which an expression goes on, so that a slash begins a regular expression and ``function`` no statement.
_BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else await yield export default extends".split())


def tokens(source: str, language: str) -> Iterator[Token]:
    """The code's tokens; a template is its pieces of text, with the tokens of what it puts in between."""
    scan, at, depth, last, templates = _SCANNERS[language].match, 0, 0, None, []
    while at < len(source):
        start = at
        if language == "javascript" and (source[at] == "`" or (templates and source[at] == "}" and templates[-1] == depth)):
            # a template begins, or goes on behind what was put in
            if source[at] == "}":
                depth -= 1
                templates.pop()
            piece = _TEMPLATE.match(source, at + 1)
            at = piece.end()
            last = Token("template", source[start:at], start, at, depth)
            yield last
            if piece[1] == "${":
                depth += 1
                templates.append(depth)
                last = None
            continue
        if language == "javascript" and source[at] == "/" and source[at + 1 : at + 2] not in ("/", "*") and not _operand(last) and (found := _REGEX.match(source, at)):
            at = found.end()
            last = Token("regex", found[0], start, at, depth)
            yield last
            continue
        found = scan(source, at)
        at, kind = found.end(), found.lastgroup
        if kind == "skip":
            continue
        if kind == "close":
            depth = max(depth - 1, 0)
        last = Token(kind, found[0], start, at, depth)
        yield last
        depth += kind == "open"


def _operand(last: Token | None) -> bool:
    """Whether a token may end an operand."""
    return last is not None and (last.kind in ("number", "string", "template", "regex", "close") or (last.kind == "word" and last.text not in _BEFORE_OPERAND))


def javascript_imports(source: str) -> list[str]:
    """Modules of import statements and of calls of ``require`` with strings, in order."""
    found, out = [*tokens(source, "javascript")], []
    text = lambda k: found[k].text if 0 <= k < len(found) else ""
    for k, token in enumerate(found):
        if token.kind != "word" or text(k - 1) == "." or text(k + 1) == ":":
            continue
        if token.text == "import" and text(k + 1) not in ("(", "."):
            at = k + 1
            while at < len(found) and found[at].kind != "string" and text(at) != ";" and text(at) not in ("=", "import"):
                at += 1
                # names in braces may be strings
                while at < len(found) and found[at].depth > token.depth:
                    at += 1
            if at < len(found) and found[at].kind == "string" and (at == k + 1 or text(at - 1) == "from"):
                out.append(found[at].text.strip("'\""))
        elif token.text == "require" and text(k + 1) == "(":
            at = k + 2
            while at < len(found) and found[at].depth > found[k + 1].depth:
                alone = text(at - 1) in ("(", ",") and text(at + 1) in (")", ",")
                if found[at].kind == "string" and alone and found[at].depth == found[k + 1].depth + 1:
                    out.append(found[at].text.strip("'\""))
                at += 1
    return out


def java_imports(source: str) -> list[str]:
    """Dotted names of import declarations, without ``static`` and ``.*``."""
    found, out = [*tokens(source, "java")], []
    for k, token in enumerate(found):
        if token.text == "import" and token.kind == "word" and token.depth == 0 and (k == 0 or found[k - 1].text in (";", "}")):
            names, at = [], k + 1
            while at < len(found) and found[at].text != ";" and (found[at].kind == "word" or found[at].text in (".", "*")):
                names += [found[at].text] if found[at].kind == "word" and not (at == k + 1 and found[at].text == "static") else []
                at += 1
            if names and at < len(found) and found[at].text == ";":
                out.append(".".join(names))
    return out


def _body_end(found: list[Token], k: int) -> int | None:
    """The end of the first braces beside token ``k``, behind it."""
    for i in range(k + 1, len(found)):
        if found[i].text == "{" and found[i].depth == found[k].depth:
            return next((found[j].end for j in range(i + 1, len(found)) if found[j].kind == "close" and found[j].depth == found[k].depth), found[-1].end)
        if found[i].text == ";" and found[i].depth == found[k].depth:
            return None
    return None


def definitions(source: str, language: str) -> list[tuple[int, int]]:
    """Spans of what is declared at the top: classes, interfaces and enums of Java with their modifiers and annotations; classes and functions of JavaScript that aren't exported, generators or parts of expressions."""
    found, out, begin = [*tokens(source, language)], [], None
    for k, token in enumerate(found):
        if token.depth or (out and token.start < out[-1][1]):
            continue
        last = found[k - 1] if k else None
        if language == "java":
            if last is None or last.text == ";" or (last.text == "}" and last.depth == 0) or begin is None or (out and begin < out[-1][1]):
                begin = token.start
            if token.text in ("class", "interface", "enum") and token.kind == "word" and last_text(last) not in ("@", ".") and (end := _body_end(found, k)):
                out.append((begin, end))
            continue
        if token.kind != "word" or token.text not in ("class", "function"):
            continue
        begin = k - 1 if token.text == "function" and last_text(last) == "async" else k
        # decorators stand before a class
        before = found[begin - 1] if begin else None
        named = k + 1 < len(found) and found[k + 1].kind == "word"
        if named and (before is None or before.text == ";" or _operand(before)) and (end := _body_end(found, k)):
            out.append((found[begin].start, end))
    return out


def last_text(token: Token | None) -> str:
    return token.text if token else ""

"""Imports and definitions amid strings, templates, comments, regular expressions and nested braces."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from stratum.functions import lexing
from stratum.operators import chunking, imports

JS = r"""// import a from 'no1'
/* import b from 'no2'; require('no3') */
'use strict'; import one from 'one'
import {x as y, "odd name" as z} from "two"; import * as n from 'three';
import 'four'; import type T from 'five'
const s = "import q from 'no4'", t = 'require("no5")', u = `import v from 'no6' ${require('six') + `${require("seven")} }`} require('no7')`;
const r = /require('no8')/g, d = 4 / 2 / require('eight'), e = [/['"`]/, require('nine')];
obj.require('no9'); import('no10'); import.meta.url; const o = {require: 1, import: 2}; require(name); require(`no11`);
const multi = require(
  // here
  'ten'
); require('a' + 'no12'); export * from 'no13'; require("déjà")
"""
JAVA = """package p; // import no.A;
/* import no.B; */ import java.util.List;
import static a.b . C.*; import q.* ;
import /* why */ odd.Name;
@Ann({"import no.C;", ";"}) class X { String s = "import no.D;"; String t = \"\"\"
import no.E;
\"\"\"; char c = '"'; /* import no.F; */ }
"""


def test_imports_are_code():
    assert lexing.javascript_imports(JS.encode().decode("latin-1")) == ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "déjà".encode().decode("latin-1")]
    assert imports.imports_of("a.ts", JS)[-1] == "déjà"
    assert lexing.java_imports(JAVA) == ["java.util.List", "a.b.C", "q", "odd.Name"]
    assert imports.imports_of("a.java", "import a.é;") == ["a.é"]


def cut(source, language):
    data = source.encode()
    return [data[a:b].decode() for a, b in chunking.braced_definitions(language)(data)]


def test_javascript_definitions():
    one = "function f(a = {}, {b} = {b: '}'}) { return `}${ {k: `}`}.k }`; }"
    two = "class B extends mix({x: 1}) { static { /* } */ } m() { return /[}\"]/; } get x() { class In {} } }"
    three = "async function g() { if (1) { function inner() {} } }"
    source = f"import a from 'a'\nconst k = 1\n{one}\nconst h = function named() {{}}; export function no() {{}}\n{two}\nexport default class No {{}}\n{three}\nfunction* gen() {{ yield 1 }}\nx = class Y {{}};\nlet déjà = {{function: 1, class: 2}}"
    assert cut(source, "javascript") == [one, two, three]
    assert cut("function f() { if (a) {", "javascript") == ["function f() { if (a) {"] and cut("", "javascript") == [] and cut("}}}", "javascript") == []


def test_java_definitions():
    one = "@Ann(value = {A.class, B.class}, text = \"}\")\npublic final class One<T extends Comparable<T>> implements I { class In { enum E { X { int f() { return 1; } } } } char c = '}'; String s = \"\"\"\n }\n\"\"\"; }"
    two, three = "interface Two { default void m() { /* } */ } }", "/* not this */".replace("/* not this */", "protected enum Three { A, B; }")
    source = f"package p;\nimport a.B;\n{one}\n// class No {{\nrecord R(int x) {{ R {{ }} }}\n@interface Mark {{ int v() default 1; }}\n{two} {three}"
    assert cut(source, "java") == [one, two, three]


@given(st.lists(st.sampled_from(["'", '"', "`", "${", "{", "}", "/", "//", "/*", "*/", "\n", "\\", "(", ")", "import ", "from ", "require(", "'m'", "function f", "class A ", "é", "1", "=", ";", "x"]), max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_any_text_is_read_to_its_end(source):
    """Nothing raises or hangs, tokens follow one another, and spans don't overlap."""
    for language in ("java", "javascript"):
        text = source.encode().decode("latin-1")
        found = [*lexing.tokens(text, language)]
        assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False)) and all(t.start < t.end <= len(text) and t.depth >= 0 for t in found)
        spans = lexing.definitions(text, language)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        lexing.javascript_imports(text), lexing.java_imports(text)


def made(draw, language):
    """Source of random pieces, and the imports and definitions that it must give."""
    wanted, parts, spans, n = [], [], [], 0
    noise = {"javascript": ["// import x from 'no'\n", "/* require('no') */", "const s = 'import q from \\'no\\'';\n", "const t = `require('no') ${ {a: `}`} }`;\n", "if (a) { while (b) { c = /}['\"]/; } }\n", "x = y / z / w;\n"], "java": ["// import no.X;\n", "/* import no.Y; { */\n", "record R(int a) { String s = \"}\"; }\n"]}[language]
    for _ in range(draw.randrange(12)):
        kind, n = draw.randrange(3), n + 1
        if kind == 0:
            parts.append(draw.choice(noise))
        elif kind == 1 and (language == "javascript" or not spans):
            parts.append({"javascript": draw.choice([f"import d{n} from 'm{n}';\n", f"const q{n} = require(\"m{n}\");\n"]), "java": f"import m{n}.C;\n"}[language])
            wanted.append({"javascript": f"m{n}", "java": f"m{n}.C"}[language])
        else:
            body = "{ " + "".join(draw.choice(["{ } ", "s = \"}\"; ", "/* { */ ", "class I { } "]) for _ in range(draw.randrange(4))) + "}"
            spans.append(draw.choice({"javascript": [f"function f{n}(a) ", f"class C{n} "], "java": [f"class C{n} ", f"public interface C{n} ", f"@A enum C{n} "]}[language]) + body)
            parts += [spans[-1], "\n"]
    return "".join(parts), wanted, spans


@pytest.mark.parametrize("language", ["java", "javascript"])
def test_made_sources(language):
    draw = random.Random(5)
    for _ in range(300):
        source, wanted, spans = made(draw, language)
        read = lexing.java_imports if language == "java" else lexing.javascript_imports
        assert read(source) == wanted, source
        assert cut(source, language) == spans, source

"""The declaration scanner: what each construct gives, and where."""

import pytest

from loomgraph.functions.scanner import extract


def names(source):
    return [(s[0], s[1]) for s in extract(source)]


def test_function_and_variable_in_document_order():
    source = "export function salute(n: string) {\n  return n;\n}\n\nexport const edition = '1';\n"
    assert extract(source) == [("salute", "function", 0, 7, 2, 1), ("edition", "variable", 4, 13, 4, 26)]


@pytest.mark.parametrize(
    "source, expected",
    [
        ("", []),
        ("// only a comment\n/* const x = 1 */", []),
        ("class C {} interface I {} type T = string; enum E { A }", [("C", "class"), ("I", "interface"), ("T", "type"), ("E", "enum")]),
        ("const a = 1, b = 2;", [("a", "variable"), ("b", "variable")]),
        ("let a\nvar b", [("a", "variable"), ("b", "variable")]),
        ("const f = () => { const x = 1 }", [("f", "variable"), ("x", "variable")]),
        ("function f() { const x = 1 }", [("f", "function")]),
        ("class C { m() { const x = 1 } }", [("C", "class")]),
        ("const C = class { m() { let y = 2 } }", [("C", "variable"), ("y", "variable")]),
        ("const { a, b } = o", [("{ a, b }", "variable")]),
        ("export default function f() {}", [("f", "function")]),
        ("export default () => { const x = 1 }", []),
        ("export { a }; export * from 'm'; import x from 'y'", []),
        ("if (a) { const x = 1 } else { let y = 2 }\nfor (let i = 0; i < 2; i++) {}", []),
        ("abstract class A {}\nfunction* g() {}\nfunction s(a: string): void;\ndeclare const d: number\nnamespace N { const k = 1 }", []),
        ("interface A {}\nclass A {}", [("A", "interface"), ("A", "class")]),
        ("const f = () => { for (let i = 0;;) {} for (const z of zs) {} }", [("f", "variable"), ("i", "variable")]),
        ("const t = `a ${ (() => { const q = `}` })() } const no = 1`; const u = 1", [("t", "variable"), ("q", "variable"), ("u", "variable")]),
        ("const r = /[/'\"]const x = 1/g, s = 4 / 2", [("r", "variable"), ("s", "variable")]),
        ("const m: Map<string, number> = new Map<string, number>(), n = a < b", [("m", "variable"), ("n", "variable")]),
        ("type F<A, B = {}> = A extends B ? { k: A } : (x: B) => void\nconst z = 1", [("F", "type"), ("z", "variable")]),
        ("function f(): { a: number } { return { a: 1 } }", [("f", "function")]),
        ("async function g() {}\r\nconst w = 1\r\n", [("g", "function"), ("w", "variable")]),
        ("const o = { let: 1, const: 2 }", [("o", "variable")]),
        ("const broken = (((\nclass X {}", [("broken", "variable")]),
    ],
)
def test_constructs(source, expected):
    assert names(source) == expected


def test_columns_count_utf16_units():
    assert extract("const a = '😀'; let b = 1") == [("a", "variable", 0, 6, 0, 14), ("b", "variable", 0, 20, 0, 25)]
    assert extract("﻿const a = 1")[0][:4] == ("a", "variable", 0, 7)


@pytest.mark.parametrize("source", ["`", "'", "/*", "${", "}}}}", "const", "export", "type X =", "function", "const {", "a<b<c<d", "@", "class A extends", "\x00"])
def test_never_fails(source):
    extract(source)

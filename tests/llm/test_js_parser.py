"""The bundled grammars on valid and invalid texts of each dialect."""

import pytest

from thicket.llm.js_parser import fault

VALID = {
    "javascript": [
        "",
        "#!/usr/bin/env node\n'use strict'\n",
        "import a, { b as c, default as d } from 'x'; import * as e from \"y\"; import 'z'; import f from './g.json' with { type: 'json' };",
        "export * from 'a'; export * as b from 'c'; export { x as default, y }; const x = 1, y = 2;",
        "export default class extends A.b(c) { #p = 1; static q = 2; static { f(); } get r() { return this.#p } set r(v) {} async *s() { yield* t() } static async u() {} [v]() {} 'w'() {} 1() {} static() {} get() {} }",
        "const f = async (a, { b, c: [d] = [] }, ...e) => { for await (const x of a) await x }, g = x => ({ y: x }), h = async x => x;",
        "let { a = 1, ...rest } = o; [a, , b = 2] = c; ({ a, b } = c);",
        "label: for (let i = 0, j = 1; i < 3; i++) { if (i) continue label; else break; }",
        "for (const k in o) ; for (var v of [1, 2]) f(v)\nfor (;;) break",
        "if (a) b\nelse c\ndo x++; while (x < 5) y()",
        "switch (a) { case 1: case 2: b(); break; default: c() }",
        "try { a() } catch { b() } finally { c() }",
        "const r = /[/\\]]+[`'\"]/gi.test(s) ? a / b / c : `x${`y${z}`}${{ a: 1 }.a}w`;",
        "a ??= b?.c?.[d]?.(e) ?? f; g ||= h ** 2; i = 1_000n + 0xff + 0b1 + .5e-3;",
        "const o = { a, 'b': 1, 2: 3, [c]: 4, d() {}, get e() { return 1 }, set e(v) {}, async f() {}, *g() {}, async *h() {}, ...i, async: 1, get: 2, if: 3 };",
        "new (foo())(1); new a.b.c; new.target; import.meta.url; import('x').then(y => y)",
        "x = a\n++b\nvar of = 1, async = 2, get = 3, type = 4\nasync\nfunction z() {}",
        "/* <<<<<<< */ const s = `\n<<<<<<< a\n=======\n>>>>>>> b\n`",
        "a = b >> c >>> d; a >>= 1; a >>>= 2; if (#p in o) {}",
        "(function () { return 1 })();\n!function(e,t){'use strict';e['a']&&(t.b=!0)}(this,{});",
        "x = y\n/re/g.exec(z)",
        "if (a) /re/.test(b)",
        "const { default: d } = await import('x'); await d()",
        "app.get('/x', async function (q, r) {}); const f = async function* () {}, o = { f: async function () {} };",
        "await using x = y; for (using z of w) ; async\nfunction g() {}",
        "l: for (;;) { switch (a) { case 1: continue; default: break } for (const b of c) if (b) break l; else break }",
        "x = { break: 1, continue: 2, return: 3 }; x.break; class B { break() {} return = 1; static { for (;;) break } }",
        "a()\n\n// more to come...\n",
        "a()\n// {",
        "a()\n// TODO (unfinished\n",
        "// only 'this",
        "a() /* { */ // /*",
    ],
    "jsx": [
        "const A = () => (<><B.C a='1' b={2} {...c} d:e=\"f\" g>text {h} {/* i */} {...j}<K/></B.C></>);",
        "const x = <p>{y}{<b/>}</p>, z = <p a={y} b={<b/>} c={/re/}/>, w = <A><B c={<D/>}/><B c={<D/>}/></A>;",
        "const x = a < b ? <p>don't {`${n} shown`}</p> : <q r={<s/>}>{t.map(u => <li key={u.id}>{u.v > 1 && <b>!</b>}</li>)}</q>;",
    ],
    "typescript": [
        "interface A<T extends object = {}> extends B<T>, C { readonly a?: string; [k: string]: any; (x: number): void; new (y: T): A<T>; m?<U>(z: U): asserts z is NonNullable<U>; get p(): number; set p(v: number) }",
        "type F<in out T> = T extends (infer U extends string)[] ? U : T extends `a${infer R}` ? R : never; type M = { -readonly [K in keyof T as `x${K}`]?: T[K] }",
        "type G = abstract new (...args: any[]) => object; type H = typeof import('x'); type I = import('y').Z<string>[]; type J = [a: string, b?: number, ...rest: boolean[]]; type K = | 'a' | -1 | unique symbol",
        "export abstract class D<T> extends E<T> implements F, G { private readonly a: string = ''; declare b: number; static #c?: T; constructor(public x: number, private y?: string) { super() } abstract m(): void; protected async n<U>(this: D<T>, u: U): Promise<U> { return u } [k: string]: unknown; override o!: string; accessor p = 1 }",
        "enum A { B = 1, C = 'x', 'D-e' = B << 2 } const enum F { G } declare module 'm' { export const a: number; function f(): void } namespace N.O { export let p = 1 } declare global { interface Window { q: string } }",
        "function f(a: string): void; function f(a: number): void; function f(a: any, b?: number, ...c: string[]): asserts a is string {}",
        "const a = <string>b, c = d as unknown as Map<string, Array<number>>, e = f!.g!, h = i satisfies J, k = <T,>(x: T): x is T => true, l = new Map<string, number>(), m = n<string>(o), p = q < r;",
        "import type { A } from 'a'; import { type B, type C as D } from 'b'; export type { E } from 'e'; import F = require('f'); export = F;",
        "let x: Record<string, number> = {}; let y: (a: number) => string; let z!: string; const [s, t] = u<V>(null);",
        "const a = b ? (c) : d; const e = (f): string => f; const g = async <T>(h: T) => h; type = 1; declare\nabstract\nvar o: { a: 1, b(): void; c?: 2 }",
        "export const F = ['a'] as const; for (const [k, v] of Object.entries(x) as [string, number][]) {}",
        "type T = A extends infer U extends string ? U : never; type S = A extends [infer H extends string, ...infer R] ? H : never; type Q = A extends (infer U extends number ? 1 : 2) ? U : 3;",
        "@dec() class A { @b.c d = 1; @e() f(@g h: string) {} }",
    ],
    "tsx": [
        "const A = <T,>(p: P<T>): JSX.Element => <B<T> x={y as string}>{z!}</B>; const [open, set] = useState<boolean>(false);",
        "export default function C({ a, b = 1 }: Props) { return <div>{a.map((x: number) => <i key={x}/>)}</div> }",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}', " [] ", '"x"', "1"],
}
INVALID = {
    "javascript": [
        "const a", "const x: number = 1;", "let a = <p/>;", "interface A {}", "function f( {", "f(1,", "a b", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "var s = 'abc", "x = `abc${d", "/* abc", "if (a {}",
        "break", "if (a) { continue }", "for (;;) { function f() { break } }", "switch (a) { case 1: continue }", "while (1) { x = () => { continue } }", "{ return }",
        "class A { private b }", "return 1", "x = {a: 1,, b: 2}", "...", "a = 08", "let if = 1", "import { a from 'b'", "export default", "for (let i = 0; i < 3) {}", "{ a: 1, b: 2 }", "throw\na", "a ? b", "else {}", "enum A {}", "x = /a", "\x00",
    ],
    "jsx": ["<a></b>", "x = <a>", "<a>{b}</a", "const a: string = <b/>", "<a b=c/>", "x = <p>a > b</p>", "enum A {}"],
    "typescript": ["const a = <p>text</p>;", "interface A { b: }", "type A =", "let x: = 1", "function f(a: ) {}", "class A { b: string c: number }", "enum A { B C }", "a as"],
    "tsx": ["const a = <string>b;", "x: <a", "const A = () => <div>"],
    "json": ["", "{'a': 1}", '{"a": 1,}', "[1,]", "// c\n{}", "{a: 1}", '{"a": 1} {"b": 2}', "NaN", "01", '"a\nb"', '{"a"', "+1", "[1 2]", "undefined"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert fault(text, language) is None


@pytest.mark.parametrize("language,text", [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(language, text):
    offset, message = fault(text, language)
    assert 0 <= offset <= len(text) and message


def test_dialects_nest():
    for text in VALID["javascript"]:
        assert fault(text, "typescript") is None and fault(text, "jsx") is None, text
    for text in VALID["jsx"]:
        assert fault(text, "tsx") is None


def test_offset_is_the_first_error():
    text = "const a = 1;\nconst b = ;\nconst c = ;"
    assert fault(text, "javascript")[0] == text.index(";\nconst c")


def test_deep_and_long():
    assert fault("x = " + "[" * 3000 + "]" * 3000, "javascript") is None
    assert fault("x = 1" + " + 1" * 100_000, "javascript") is None
    assert fault("[" * 100_000 + "]" * 100_000, "json") is None
    assert fault("x = " + "[" * 50_000 + "]" * 50_000, "javascript") is None

from lodeseek.operators.code import _builtin_spans, pieces_of

RUST = """use std::fmt;
mod b;
/// doc { brace
#[derive(Debug)]
pub struct Counter { n: u32 }
struct Unit;
pub enum E { A, B { x: u8 } }
impl Counter {
    pub fn new() -> Self { Counter { n: 0 } }
    pub async fn go<'a>(&'a self) where Self: Sized { match 'x' { '{' => {}, _ => {} } }
}
impl fmt::Display for Counter { fn fmt(&self) -> R { write!(f, "{{}}") } }
impl<T: Foo<u8>> Bar for Vec<T> {}
impl<T> Vec<T> { }
trait Tr { fn sig(&self); fn dflt(&self) {} }
"""
GO = """package main
type ID int
type Foo struct {
  a int
}
type (
  A struct { x int }
)
func Hello(x int) string {
  return "}" + `{`
}
func (f *Foo) Bar() error {
  go func() { }()
  return nil
}
"""
JS = """const a = 1
async function foo(x) { if (x) { return `a${x}}` } }
export default function bar() {}
const f = function named() { }
const g = () => { foo(1) }
class A extends B {
  constructor(x) { super(x) }
  static async m(a = {b: 1}) { for (const y of z) { } }
  get v() { return /[{]/.test(s) }
}
foo({ bar2() { return 1 } })
describe("x", function () { it("y", () => {}) })
"""
TS = """export interface I { a(): void; b: string }
abstract class Abs { abstract q(): void; run(): number { return 1 } }
export class K { private async foo<T>(x: T): Promise<T> { return x } }
function over(a: string): void
function over(a: any) { }
"""
JAVA = """package x;
@Deprecated
public class Foo<T> extends Bar {
  private int x = calc(1);
  public Foo() { this.x = 1; }
  @Override
  public String toString() { if (x) { } return "{"; }
  abstract void q(int a);
  List<Map<String, T>> get(int a) throws E { return new ArrayList<>() {{ add(1); }}; }
  enum Color { RED, GREEN; int z() { return 1; } }
}
interface I { void m(); }
"""
KOTLIN = """package x
data class P(val a: Int)
class C(
  val b: Int
) : Base() {
  fun f(x: Int): Int { return x }
  private fun g() = 3
  fun <T> List<T>.h(y: T) = when (y) { else -> 1 }
}
interface I { fun m(): Int }
object O { fun z() { } }
"""


def found(lang, text):
    pieces = pieces_of(lang, text, _builtin_spans)
    # What lies between declarations has a test of its own.
    named = [p for p in pieces if not p["symbol"].startswith("module@")]
    return [(p["symbol"], p["kind"], p["start_line"], p["end_line"]) for p in named]


def test_rust():
    assert found("rust", RUST) == [
        ("Counter", "class", 5, 5),
        ("Unit", "class", 6, 6),
        ("E", "class", 7, 7),
        ("Counter", "impl", 8, 11),
        ("new", "function", 9, 9),
        ("go", "function", 10, 10),
        ("Counter", "impl", 12, 12),
        ("fmt", "function", 12, 12),
        ("Bar", "impl", 13, 13),
        ("anon@14", "impl", 14, 14),
        ("Tr", "class", 15, 15),
        ("dflt", "function", 15, 15),
    ]


def test_go():
    assert found("go", GO) == [
        ("anon@2", "class", 2, 2),
        ("anon@3", "class", 3, 5),
        ("anon@6", "class", 6, 8),
        ("Hello", "function", 9, 11),
        ("Bar", "method", 12, 15),
    ]


def test_javascript():
    assert found("javascript", JS) == [
        ("foo", "function", 2, 2),
        ("bar", "function", 3, 3),
        ("A", "class", 6, 10),
        ("constructor", "method", 7, 7),
        ("m", "method", 8, 8),
        ("v", "method", 9, 9),
        ("bar2", "method", 11, 11),
    ]


def test_typescript_and_tsx():
    want = [
        ("I", "class", 1, 1),
        ("run", "method", 2, 2),
        ("K", "class", 3, 3),
        ("foo", "method", 3, 3),
        ("over", "function", 5, 5),
    ]
    assert found("typescript", TS) == want and found("tsx", TS) == want


def test_java():
    assert found("java", JAVA) == [
        ("Foo", "class", 2, 11),
        ("toString", "method", 6, 7),
        ("q", "method", 8, 8),
        ("get", "method", 9, 9),
        ("z", "method", 10, 10),
        ("I", "class", 12, 12),
        ("m", "method", 12, 12),
    ]


def test_kotlin():
    assert found("kotlin", KOTLIN) == [
        ("P", "class", 2, 2),
        ("C", "class", 3, 9),
        ("f", "function", 6, 6),
        ("g", "function", 7, 7),
        ("h", "function", 8, 8),
        ("I", "class", 10, 10),
        ("m", "function", 10, 10),
        ("z", "function", 11, 11),
    ]


def test_contents_are_slices_of_the_text():
    for lang, text in (("rust", RUST), ("go", GO), ("java", JAVA), ("kotlin", KOTLIN)):
        for p in pieces_of(lang, text, _builtin_spans):
            lines = text.split("\n")[p["start_line"] - 1 : p["end_line"]]
            assert p["content"] in "\n".join(lines)


def test_unbalanced_text_is_survived():
    for lang in ("rust", "go", "javascript", "java", "kotlin"):
        assert isinstance(found(lang, "}}} {{{ ((( fn x( class A { \n ) ]"), list)

"""Statements, declarations and references of the languages with braces; comments and strings declare nothing."""

import random
import time

import pytest

from tesserae.functions import parsers, scanner


def found(language, text):
    symbols, references = parsers.parse("src/x", language, text)
    return {(s[2], s[4]) for s in symbols}, {r[2:5] for r in references}, {s[4]: (s[8], s[9]) for s in symbols}


JAVA = """package shop;
import shop.store.Shelf;
/* class Phantom { void walk() {} } */
interface Priced {}
abstract class Goods
        extends Thing
        implements Priced,
                   java.io.Serializable {
    private Shelf shelf;
    String note = "class Quoted { void no() {} }"; // void gone() {}
    Goods(int n) { super(n); }
    public <T> java.util.List<T> price(
            final int amount,
            @Named("x") String label
    ) throws java.io.IOException {
        Tax tax = new Tax();
        if (amount > 1) { tax.add(amount); }
        Runnable later = () -> { notifyAll2(); };
        return round(amount);
    }
    abstract int weight();
    enum Size implements Priced { S, L; int rank() { return 1; } }
}
"""


def test_java():
    kinds, links, lines = found("java", JAVA)
    assert kinds == {("interface", "Priced"), ("abstract class", "Goods"), ("method", "Goods.price"), ("method", "Goods.weight"), ("enum", "Goods.Size"), ("method", "Goods.Size.rank")}
    assert links >= {(None, "imports", "shop.store.Shelf"), ("Goods", "extends", "Thing"), ("Goods", "extends", "Priced"), ("Goods", "extends", "java.io.Serializable"), ("Goods", "uses", "Shelf")}
    assert links >= {("Goods.price", "creates", "Tax"), ("Goods.price", "calls", "Tax.add"), ("Goods.price", "calls", "round"), ("Goods.price", "calls", "notifyAll2"), ("Goods.Size", "extends", "Priced")}
    assert not any(t in ("no", "gone", "walk", "String") for _, _, t in links)
    assert lines["Goods"] == (5, 23) and lines["Goods.price"] == (12, 20)


GO = """package store
import (
	"fmt"
	alias "net/url"
)
// type Ghost struct {}
type Shop struct { tax *Tax }
type Priced interface {
	Price() int
}
func round(v int) int { return v }
func (s *Shop) Sell(
	items []string,
	each func(a int) error,
) (int, error) {
	text := `func no() {`
	round(len(items)); s.tax.Add(1)
	run(func() { inner() })
	return 1, nil
}
func Map[T any, U any](xs []T, f func(T) U) []U { return nil }
"""


def test_go():
    kinds, links, lines = found("go", GO)
    assert kinds == {("struct", "Shop"), ("interface", "Priced"), ("function", "round"), ("method", "Shop.Sell"), ("function", "Map")}
    assert links == {(None, "imports", "fmt"), (None, "imports", "net/url"), *((("Shop.Sell"), "calls", t) for t in ("round", "s.tax.Add", "run", "inner"))}
    assert lines["Shop.Sell"] == (12, 20) and lines["Priced"] == (8, 10)


TYPESCRIPT = """import { Shelf } from "./shelf";
interface Priced extends Named {}
class Tax {}
function round<T>(a: T): number {
  return 1
}
const quick = () => round()
export const slow = async (a: string, b = { x: 1 }): Promise<void> => {
  await round()
}
// class Nope {}
export default class Shop<T> extends Base<T> implements Priced, Named {
  private shelves: Shelf[] = []
  constructor(private tax: Tax) { super() }
  async sell(
    amount: number,
  ): Promise<Tax> {
    if (amount) { this.tax.add(`x ${amount} class Quoted {`) }
    items.forEach((i) => { each(i) })
    return new Tax()
  }
}
type Shape = { a: number }
export enum Kind { A, B }
"""


@pytest.mark.parametrize("language", ["typescript", "javascript"])
def test_scripts(language):
    kinds, links, lines = found(language, TYPESCRIPT)
    every = {("class", "Tax"), ("function", "round"), ("function", "quick"), ("function", "slow"), ("class", "Shop"), ("method", "Shop.sell")}
    assert kinds == (every | {("interface", "Priced"), ("type", "Shape"), ("enum", "Kind")} if language == "typescript" else every)
    assert links >= {(None, "imports", "./shelf"), ("quick", "calls", "round"), ("slow", "calls", "round"), ("Shop", "extends", "Base"), ("Shop", "extends", "Priced"), ("Shop.sell", "calls", "each"), ("Shop.sell", "creates", "Tax"), ("Shop.sell", "calls", "this.tax.add")}
    assert language == "javascript" or links >= {("Shop", "uses", "Shelf"), ("Shop", "uses", "Tax")}
    assert lines["Shop"] == (12, 22) and lines["slow"] == (8, 10)


CPP = """#include <vector>
#include "tax.h"
#define OPEN {
namespace shop {
template<typename T>
class Shelf : public Base<T>, private detail::Rack {
public:
  Shelf() : a_(1), b_{2} { init(); }
  void put(const T& item) { items.push_back(item); }
  T get(int index);
  virtual ~Shelf() {}
  Tax tax_;
};
template<typename T>
T larger(T a, T b) { return (a > b) ? a : b; }
}
int shop::Till::total(
    int& ref, Shelf* ptr) const {
#pragma HLS PIPELINE II=1
  auto s = R"x(void no() {)x";
  Tax tax; tax.add(); shop::larger<int>(1, 2); char c = '{';
  return 0;
}
static inline void demo() { helper(); }
enum class Kind : int { A };
"""


def test_cpp():
    kinds, links, lines = found("cpp", CPP)
    assert kinds == {("template_class", "Shelf"), ("method", "Shelf.Shelf"), ("method", "Shelf.put"), ("method", "Shelf.~Shelf"), ("function", "larger"), ("method", "shop.Till.total"), ("function", "demo"), ("enum", "Kind")}
    assert links >= {(None, "include", "vector"), (None, "include", "tax.h"), (None, "hls_pragma", "PIPELINE II=1"), ("Shelf", "extends", "Base"), ("Shelf", "extends", "detail::Rack"), ("Shelf", "uses", "Tax")}
    assert links >= {("shop.Till.total", "calls", "Tax.add"), ("shop.Till.total", "calls", "shop::larger"), ("demo", "calls", "helper"), ("Shelf.put", "calls", "items.push_back")}
    assert not any(t in ("no", "get") for _, _, t in links) and lines["shop.Till.total"] == (17, 23)


def test_other_languages():
    kinds, links, _ = found("rust", "use std::io;\n// fn gone() {}\npub struct P<T> where T: Copy { x: T }\npub trait Area: Debug { fn area(&self) -> f64; }\nimpl<T> Area for P<T> { fn area(&self) -> f64 { let c = '{'; compute::<T>(1) } }\nimpl P<i32> {\n pub async fn new(a: &'a str,\n  b: i32) -> Self { P { x: 1 } } }\nfn main() { P::new(\"fn no() {\", 2); }\n")
    assert kinds == {("struct", "P"), ("trait", "Area"), ("method", "Area.area"), ("method", "P.area"), ("method", "P.new"), ("function", "main")}
    assert links >= {("P", "extends", "Area"), ("Area", "extends", "Debug"), ("P.area", "calls", "compute"), ("main", "calls", "P::new"), (None, "imports", "std::io")}
    kinds, links, _ = found("csharp", 'using System.Text;\nnamespace N {\npublic class A<T> : Base, IThing where T : new() {\n private readonly Dep _dep;\n public async Task<int> Run(int a,\n  string b = "x") { _dep.Go(); var q = new Foo(); return 1; }\n public int Two() => Helper(2);\n}\npublic interface IThing { void X(); }\n}')
    assert kinds == {("class", "A"), ("method", "A.Run"), ("method", "A.Two"), ("interface", "IThing"), ("method", "IThing.X")}
    assert links >= {("A", "extends", "Base"), ("A", "extends", "IThing"), ("A", "uses", "Dep"), ("A.Run", "calls", "Dep.Go"), ("A.Run", "creates", "Foo"), ("A.Two", "calls", "Helper")}
    kinds, links, _ = found("php", "<?php\nuse App\\User;\n# class No {}\nabstract class A extends B implements C, D {\n public function run(int $a,\n  ?string $b = null): ?string { return new Foo(); }\n}\nfunction helper($x) { A::make($x); }\n")
    assert kinds == {("abstract class", "A"), ("method", "A.run"), ("function", "helper")}
    assert links >= {("A", "extends", "B"), ("A", "extends", "C"), ("A", "extends", "D"), ("A.run", "creates", "Foo"), ("helper", "calls", "A::make")}
    kinds, links, lines = found("c", '#include "a.h"\nstruct list { struct node *head; };\nstatic int add(int a,\n   int b)\n{ return sub(a, b); }\nint decl(int a);\n/* int no(void) {} */\n')
    assert kinds == {("struct", "list"), ("function", "add")} and links == {(None, "include", "a.h"), ("add", "calls", "sub")} and lines["add"] == (3, 5)


def test_continued_lines():
    kinds, links, _ = found("cmake", "add_library(foo STATIC\n a.cc\n b.cc)\n# add_library(no)\ntarget_link_libraries(foo\n PUBLIC bar\n baz::qux)\n")
    assert kinds == {("library", "foo")} and links >= {(None, "link_dependency", "bar"), (None, "link_dependency", "baz::qux")}
    kinds, links, _ = found("makefile", "all: a.o \\\n b.o # c.o\n\tcc -o x\nclean:\n\trm x\n")
    assert kinds == {("target", "all"), ("target", "clean")} and links == {("all", "prerequisite", "a.o"), ("all", "prerequisite", "b.o")}
    assert found("toml", '[a]\nx = """\n[no]\n"""\n[[b]]\n')[0] == {("table", "a"), ("table_array", "b")}
    assert found("bash", "foo() {\n  bar \\\n   baz\n}\n# qux\n")[1] == {("foo", "calls", "bar")}


def test_masks_keep_places_and_statements_cover_the_text():
    r = random.Random(4)
    parts = ["class A {", "}", ";", "\n", "// x {\n", "/* { \n */", '"a{\\"b"', "'{'", "f(", ")", "a = {", "=> {", "`t\n{`", "x", " ", "(", "[", "]"]
    for language in scanner.MARKS:
        for _ in range(150):
            text = "".join(r.choice(parts) for _ in range(r.randrange(40)))
            spoken, bare = scanner.masked(text, language)
            assert len(spoken) == len(bare) == len(text) and bare.count("\n") == text.count("\n")
            cuts = list(scanner.statements(bare))
            assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(a[1] + 1 == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
            symbols, _ = parsers.parse("p", language, text)
            assert all(1 <= s[8] <= s[9] <= text.count("\n") + 1 for s in symbols)


@pytest.mark.parametrize("language", sorted(scanner.MARKS))
def test_long_files_take_linear_time(language):
    for part in ("f(", "{", "class A ", "int f(int a, ", "int f(int a) ", "a < b ", "x::", '"', "/*", "class A {", "a b<", "x = ", "const a = (", "@A(1) ", "int ", "\n", "A, "):
        for close in ("", "{", ";"):
            began = time.process_time()
            parsers.parse("p", language, part * (15_000 // len(part)) + close)
            assert time.process_time() - began < 1, (part, close)

from siltstone.functions.text import VM_CONTEXT
from siltstone.sources.parsing.common import C_SKIPPED, PY_SKIPPED
from siltstone.sources.parsing.table import parse, parse_source, with_code_behind

PY = '''import os
import numpy as np
from a.b import c as d

글 = "한글"

@deco(1)
def outer(x):
    def inner():
        return helper(글)
    return inner() + np.sum(x)

class Shape(Base):
    size = compute()

    def area(self):
        return self.w() * os.path.join("a")
'''
CS = '''using System;
namespace Lab.Core {
  // class Fake {
  public class Engine : Base {
    public string Name { get; set; }
    public Engine(int n) { Start(n); }
    public void Run(Action a) {
      var s = "}"; helper.Go(s);
      var c = new Command(OnRun);
      if (s == "x") { Stop(); }
    }
    void OnRun() { }
  }
}
'''
CPP = '''#include <vector>
#include "shape.h"
namespace geo {
class Shape {
 public:
  int area() { return width() * 2; }
};
int Shape::edge(int n) { return std::max(n, helper.count()); }
}
'''
CLI = "public ref class Panel {\n  void Draw() { Paint(); }\n};\nvoid Other::go() {\n  run();\n"
XAML = '''<Window x:Class="App.Views.MainView" xmlns:x="urn:x" xmlns:vm="clr-namespace:App.Models;assembly=App"
  prism:ViewModelLocator.AutoWireViewModel="True" xmlns:prism="urn:p">
  <DataTemplate DataType="{x:Type vm:Item}"/>
  <Button Click="OnGo" Content="{Binding Path=Title.Text}"/><TextBox Text="{Binding Name}"/>
</Window>'''


def by_name(chunks):
    return {c.qualified_name: c for c in chunks}


def test_python():
    got = by_name(parse("/r/pkg/mod.py", PY, "/r"))
    assert set(got) == {"pkg.mod.outer", "pkg.mod.outer.inner", "pkg.mod.Shape", "pkg.mod.Shape.area", "pkg.mod.py"}
    assert got["pkg.mod.outer"].calls == ["helper", "inner", "np.sum"]
    shape = got["pkg.mod.Shape"]
    assert shape.type == "class" and PY_SKIPPED in shape.content and "os.path" not in shape.content and shape.calls == ["compute"]
    assert got["pkg.mod.Shape.area"].type == "function" and got["pkg.mod.Shape.area"].calls == ["os.path.join", "self.w"]
    assert got["pkg.mod.py"].content.startswith("File: mod.py\nPath: /r/pkg/mod.py")
    assert got["pkg.mod.py"].imports == {"os": "os", "np": "numpy", "d": "a.b.c"}
    bad = parse("/r/x.py", "def (", "/r")
    assert [c.status for c in bad] == ["syntax error"] and bad[0].content == "def ("


def test_csharp():
    got = by_name(parse("src/Engine.cs", CS))
    assert got["Lab.Core.Engine"].type == "class" and C_SKIPPED in got["Lab.Core.Engine"].content and "helper.Go" not in got["Lab.Core.Engine"].content
    assert got["Lab.Core.Engine.Run"].calls == ["Go", "OnRun", "Stop"]
    assert got["Lab.Core.Engine.Engine"].type == "function" and got["Lab.Core.Engine.OnRun"].calls == []
    assert got["Lab.Core.Engine.Name"].type == "property"
    assert got["Lab.Core.Engine.cs"].type == "file"
    assert len(got) == 6


def test_declarations_are_not_calls():
    """Of methods, constructors, bodiless and local functions, the names are declared; base and member initialisers call nothing."""
    code = "class C { public C() : base(G(1)) { Init(); } void M(int x) { Bar(); if (x) { OnGo(); } int L(int q) { return q; } return Foo(1); } abstract int Later(int q); int Arrow(int x) => Calc(x); }"
    got = by_name(parse("src/a.cs", code))
    assert got["C"].calls == ["Bar", "Calc", "Foo", "G", "Init", "OnGo"] and got["C.C"].calls == ["G", "Init"] and got["C.M"].calls == ["Bar", "Foo", "OnGo"]
    assert "C.Later" not in got
    code = "class C { C() : w_(0), h_(first(2)), z{g()} { reset(); } int m() { return w() + o.s() + p->t(); } int d(int q); };\nint C::edge(int n) { Item one(n); return std::max(n, help(one)); }"
    got = by_name(parse("src/c.cpp", code))
    assert got["C"].calls == ["first", "g", "reset", "s", "t", "w"] and got["C.edge"].calls == ["help", "std::max"]


def test_types_on_one_line():
    """A nested type begins at its own declaration; interfaces, structs and records are no classes, but name their members."""
    got = by_name(parse("src/b.cs", "public class A { void M() { Go(); } class B { int P() { return Q(); } } interface I { void N(); int R() { return S(); } } }\nenum Class { X }\n[Old] sealed class D { }"))
    assert set(got) == {"A", "A.M", "A.B", "A.B.P", "A.I.R", "D", "b.cs"}
    assert got["A.B"].content == "class B { int P() { /* 구현부 생략 */ } }" and got["A.B"].calls == ["Q"] and got["A.I.R"].calls == ["S"]
    assert got["A"].content.startswith("public class A {") and got["D"].content == "[Old] sealed class D { }" and got["D"].start_line == 3
    assert set(by_name(parse("src/e.cpp", "enum class E { X };\nstruct P { int x; };"))) == {"P", "e.cpp"}


def test_python_decorators():
    code = "@deco(1)\nclass K(B):\n    z = load()\n\n    @prop(2)\n    def f(self, a=dflt()):\n        return go(a)\n\n@deco2(3)\ndef g():\n    @inner_deco(1)\n    def h():\n        return call()\n    return h\n"
    got = by_name(parse("m.py", code))
    assert got["m.K"].calls == ["dflt", "load", "prop"] and got["m.K.f"].calls == ["dflt", "go"]
    assert got["m.g"].calls == ["call", "inner_deco"] and got["m.g.h"].calls == ["call"]


def test_python_lines_are_the_parsers():
    """Form feeds and other separators inside a line do not shift positions."""
    code = "x = '\x0c\u2028\x85'\ndef f():\n    return 글(1)\r\ndef g():\n    return f()\n"
    got = by_name(parse("m.py", code))
    assert got["m.f"].content == "def f():\n    return 글(1)" and got["m.g"].content == "def g():\n    return f()" and got["m.g"].start_line == 4


def test_cpp():
    got = by_name(parse("src/shape.cpp", CPP))
    assert got["geo.Shape"].type == "class" and C_SKIPPED in got["geo.Shape"].content
    assert got["geo.Shape.edge"].type == "method" and got["geo.Shape.edge"].calls == ["count", "std::max"]
    assert got["shape.cpp"].includes == ["vector", "shape.h"]
    got = by_name(parse("src/p.cpp", CLI))
    assert set(got) == {"p.Panel", "p.Panel.Draw", "Other.go", "p.cpp"}
    assert got["Other.go"].content.endswith("run();\n")


def test_markup():
    (view,) = parse("ui/MainView.xaml", XAML, code_behind="class X {}")
    assert view.calls == sorted([VM_CONTEXT + "App.ViewModels.MainViewModel", VM_CONTEXT + "App.Models.Item", "App.Views.MainView.OnGo", "Title.Text", "Name"])
    assert view.type == "view" and view.name == "MainView" and "=== Code-Behind" in view.content
    assert parse("a.xaml", "<a><b></a>") == [] and parse("a.txt", "x") == [] and parse("a.py", "") == []


def test_table(spark):
    files = [("ui/MainView.xaml", XAML), ("ui/MainView.xaml.cs", "class Y {}"), ("m.py", PY), ("n.cs", CS), ("x.py", None)]
    out = parse_source(with_code_behind(spark.createDataFrame(files, "path string, text string")))
    rows = out.collect()
    assert sum(r.type == "view" for r in rows) == 1 and {r.language for r in rows} == {"xaml", "python", "c_sharp"}
    assert "class Y" in next(r.content for r in rows if r.type == "view")


def test_long_comments_are_cut_to_one_blank_and_places_kept():
    from siltstone.sources.parsing.common import Squeezed, blanked

    note = "/*" + "long words of a note;\n" * 20_000 + "*/"
    text = f"class A {{\n  int f() {{ return new {note} B(g()).x; }}\n}} {note}"
    short = Squeezed(blanked(text))
    assert len(short.code) < 100
    assert all(text[short.at(i)] == c for i, c in enumerate(short.code) if not c.isspace()) and short.after(len(short.code)) == len(text)
    found = {c.name: c for c in parse("A.cs", text)}
    assert found["f"].content == text[text.index("int f") : text.index(" B(g") + len(" B(g()).x; }")] and found["f"].start_line == 2
    assert found["f"].calls == ["g"]  # a constructor, however far its name stands from `new`


def test_parsers_get_bounded_batches(spark):
    from siltstone.scratch import ARROW_BYTES, ARROW_ROWS

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(rows), spark.conf.get(size)
    try:
        spark.conf.set(rows, "10000")
        spark.conf.set(size, str(1 << 30))
        files = spark.range(2500).selectExpr("concat('f', id, '.py') path", "'x = 1\n' text").coalesce(1)
        assert parse_source(files).count() == 2500
        assert int(spark.conf.get(rows)) <= ARROW_ROWS and int(spark.conf.get(size)) <= ARROW_BYTES
    finally:
        spark.conf.set(rows, before[0])
        spark.conf.set(size, before[1])

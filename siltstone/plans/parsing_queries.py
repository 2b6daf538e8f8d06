"""Queries that run the parsers over source files made from every document: the whole text of a document stands in its file,
around it classes, methods, bindings. The SQL says which chunks must come out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.plans.registry import query
from siltstone.sources.parsing.common import C_SKIPPED, PY_SKIPPED
from siltstone.sources.parsing.markup import CODE_BANNER, VIEW_BANNER
from siltstone.sources.parsing.table import parse_source, with_code_behind

#: Source texts; {n}: the document's id, {lang}: its language, {text}: its text.
PYTHON = """import os
from pkg import helper as h{n}

@register({n})
class C{n}(Base):
    limit = load{n}()

    @cached(1)
    def run(self, x):
        return self.go(x) + os.path.join(x)

    def stop(self):
        pass

@deco(2)
def free{n}(a, b=default{n}()):
    note = '''{text}'''
    def inner():
        return call{n}(a)
    return inner()
"""
CSHARP = """using System;
namespace N.{lang} {
  // class Fake {
  [Serializable]
  public class C{n} : Base {
    public string Name { get; set; }
    public C{n}(int k) : base(k) { Init{n}(); }
    public void Run(Action a) {
      var s = "}"; helper.Go(s);
      var c = new Command(OnRun);
      if (s == "x") { Stop(); }
    }
    void OnRun() { }
    abstract int Later(int q);
    class Inner { void Deep() { Run(null); } }
    /* {text} */
  }
  public interface I{n} { void N(); }
  public struct S{n} { int Get() { return C{n}.Make(1); } }
}
"""
CPP = """#include <vector>
#include "v{n}.h"
namespace geo {
class Shape{n} {
 public:
  Shape{n}() : w_(0), h_(first(2)) { reset(); }
  int area() { return width() * obj.size(); }
  int late(int q);
};
struct P{n} { int x; };
enum class Color { Red };
/* {text} */
int Shape{n}::edge(int n) { return std::max(n, helper->count()); }
int lone(int a) { return a; }
}
"""
XAML = """<Window x:Class="App.Views.W{n}View" xmlns:x="urn:x" xmlns:vm="clr-namespace:App.M{lang};assembly=App" xmlns:p="urn:p"
  p:ViewModelLocator.AutoWireViewModel="True" Title="{Binding Path=Title.Text}">
  <DataTemplate DataType="{x:Type vm:Item{n}}"/>
  <Button Click="OnGo" Loaded="OnLoad" Content="{Binding Name{n}}"/>
  <TextBlock MouseMove="Ignored">{text}</TextBlock>
</Window>
"""
_LINES = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))"
_LANG = "coalesce(lang, 'xx')"


def _source(template: str, text: Column) -> Column:
    """The template with a document's id, language and text put in."""
    out = F.lit(template)
    for mark, value in (("{n}", F.col("doc_id").cast("string")), ("{lang}", F.coalesce("lang", F.lit("xx"))), ("{text}", text)):
        out = F.replace(out, F.lit(mark), value)
    return out


def _path(folder: str, name: str, suffix: str) -> Column:
    return F.concat(F.lit(folder), F.coalesce("lang", F.lit("xx")), F.lit("/" + name), F.col("doc_id").cast("string"), F.lit(suffix))


def _uncommented(text: Column) -> Column:
    """A text that may stand in a comment of the brace languages."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("*/"), F.lit("--"))


def _spread(files):
    """Files dealt out by path: a table that is one row group would be parsed by one task, and parsing costs far more than moving."""
    return files.repartition("path")


def _chunks(files):
    rows = parse_source(_spread(files))
    return rows.select("filepath", "qualified_name", "name", "type", "start_line", "calls", F.when(F.col("type").isin("class", "file"), F.col("content")).alias("content"), "status")


def _rows(*rows: tuple[str, ...]) -> str:
    """SELECTs of one chunk a document: qualified name, name, type, line, calls, content (SQL expressions of d)."""
    return " UNION ALL ".join(
        f"SELECT filepath, {qn} AS qualified_name, {name} AS name, '{kind}' AS type, CAST({line} AS INT) AS start_line, CAST({calls} AS VARCHAR[]) AS calls, {content} AS content, 'ok' AS status FROM d" for qn, name, kind, line, calls, content in rows
    )


def _sql_text(template: str) -> str:
    """A template (with {n}) as an SQL expression."""
    return "replace('" + template.replace("'", "''") + "', '{n}', n)"


_FILE = "concat('File: ', regexp_extract(filepath, '[^/]*$'), chr(10), 'Path: ', filepath, chr(10), 'Summary: ')"
_PY_CLASS = f"class C{{n}}(Base):\n    limit = load{{n}}()\n\n    @cached(1)\n    def run(self, x):{PY_SKIPPED}\n\n    def stop(self):{PY_SKIPPED}"


@query(
    f"""WITH d AS (SELECT concat('src/', {_LANG}, '/f', CAST(doc_id AS VARCHAR), '.py') AS filepath, concat('src.', {_LANG}, '.f', CAST(doc_id AS VARCHAR)) AS m, CAST(doc_id AS VARCHAR) AS n, {_LINES} AS k FROM documents)
{_rows(
    ("concat(m, '.C', n)", "concat('C', n)", "class", "5", "['cached', concat('load', n)]", _sql_text(_PY_CLASS)),
    ("concat(m, '.C', n, '.run')", "'run'", "function", "9", "['os.path.join', 'self.go']", "NULL"),
    ("concat(m, '.C', n, '.stop')", "'stop'", "function", "12", "[]", "NULL"),
    ("concat(m, '.free', n)", "concat('free', n)", "function", "16", "[concat('call', n), concat('default', n), 'inner']", "NULL"),
    ("concat(m, '.free', n, '.inner')", "'inner'", "function", "18 + k", "[concat('call', n)]", "NULL"),
    ("concat(m, '.py')", "concat('f', n, '.py')", "file", "1", "[]", _FILE),
)}"""
)
def parse_source_python(t):
    safe = F.translate(F.coalesce("text", F.lit("")), "\\'\r", "|||")
    return _chunks(t.documents.select(_path("src/", "f", ".py").alias("path"), _source(PYTHON, safe).alias("text")))


_CS_CLASS = f"""[Serializable]
  public class C{{n}} : Base {{
    public string Name {{ get; set; }}
    public C{{n}}(int k) : base(k) {C_SKIPPED}
    public void Run(Action a) {C_SKIPPED}
    void OnRun() {C_SKIPPED}
    abstract int Later(int q);
    class Inner {{ void Deep() {C_SKIPPED} }}
    /* """
_CS_CALLS = "['Go', concat('Init', n), 'OnRun', 'Run', 'Stop']"


@query(
    f"""WITH d AS (SELECT concat('src/', {_LANG}, '/C', CAST(doc_id AS VARCHAR), '.cs') AS filepath, concat('N.', {_LANG}) AS m, CAST(doc_id AS VARCHAR) AS n, {_LINES} AS k, replace(coalesce(text, ''), '*/', '--') AS t FROM documents)
{_rows(
    ("concat(m, '.C', n)", "concat('C', n)", "class", "4", _CS_CALLS, f"concat({_sql_text(_CS_CLASS)}, t, ' */', chr(10), '  }}')"),
    ("concat(m, '.C', n, '.Name')", "'Name'", "property", "6", "[]", "NULL"),
    ("concat(m, '.C', n, '.C', n)", "concat('C', n)", "function", "7", "[concat('Init', n)]", "NULL"),
    ("concat(m, '.C', n, '.Run')", "'Run'", "function", "8", "['Go', 'OnRun', 'Stop']", "NULL"),
    ("concat(m, '.C', n, '.OnRun')", "'OnRun'", "function", "13", "[]", "NULL"),
    ("concat(m, '.C', n, '.Inner')", "'Inner'", "class", "15", "['Run']", f"'class Inner {{ void Deep() {C_SKIPPED} }}'"),
    ("concat(m, '.C', n, '.Inner.Deep')", "'Deep'", "function", "15", "['Run']", "NULL"),
    ("concat(m, '.S', n, '.Get')", "'Get'", "function", "19 + k", "['Make']", "NULL"),
    ("concat(m, '.C', n, '.cs')", "concat('C', n, '.cs')", "file", "1", "[]", _FILE),
)}"""
)
def parse_source_csharp(t):
    return _chunks(t.documents.select(_path("src/", "C", ".cs").alias("path"), _source(CSHARP, _uncommented(F.col("text"))).alias("text")))


_CPP_CLASS = f"class Shape{{n}} {{\n public:\n  Shape{{n}}() : w_(0), h_(first(2)) {C_SKIPPED}\n  int area() {C_SKIPPED}\n  int late(int q);\n}}"


@query(
    f"""WITH d AS (SELECT concat('src/', {_LANG}, '/v', CAST(doc_id AS VARCHAR), '.cpp') AS filepath, CAST(doc_id AS VARCHAR) AS n, {_LINES} AS k FROM documents)
{_rows(
    ("concat('geo.Shape', n)", "concat('Shape', n)", "class", "4", "['first', 'reset', 'size', 'width']", _sql_text(_CPP_CLASS)),
    ("concat('geo.P', n)", "concat('P', n)", "class", "10", "[]", "concat('struct P', n, ' { int x; }')"),
    ("concat('geo.Shape', n, '.edge')", "'edge'", "method", "13 + k", "['count', 'std::max']", "NULL"),
    ("concat('v', n, '.cpp')", "concat('v', n, '.cpp')", "file", "1", "[]", _FILE),
)}"""
)
def parse_source_cpp(t):
    return _chunks(t.documents.select(_path("src/", "v", ".cpp").alias("path"), _source(CPP, _uncommented(F.col("text"))).alias("text")))


@query(
    f"""SELECT concat('ui/', {_LANG}, '/W', n, 'View.xaml') AS filepath, concat('App.Views.W', n, 'View') AS qualified_name, concat('W', n, 'View') AS name, 'view' AS type, CAST(1 AS INT) AS start_line,
[concat('App.Views.W', n, 'View.OnGo'), concat('App.Views.W', n, 'View.OnLoad'), concat('Name', n), 'Title.Text', concat('__vm_context__:App.M', {_LANG}, '.Item', n), concat('__vm_context__:App.ViewModels.W', n, 'ViewModel')] AS calls,
CASE WHEN doc_id % 2 = 0 THEN concat('class W', n, 'View : Window {{ }}') END AS behind FROM (SELECT *, CAST(doc_id AS VARCHAR) AS n FROM documents) d"""
)
def parse_source_xaml(t):
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", " ")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    path = _path("ui/", "W", "View.xaml")
    views = t.documents.select(path.alias("path"), _source(XAML, safe).alias("text"))
    behind = t.documents.where("doc_id % 2 = 0").select(F.concat(path, F.lit(".cs")).alias("path"), F.concat(F.lit("class W"), "doc_id", F.lit("View : Window { }")).alias("text"))
    rows = parse_source(_spread(with_code_behind(views.unionByName(behind))))
    parted = F.when(F.col("content").startswith(VIEW_BANNER), F.substring_index("content", CODE_BANNER, -1))
    return rows.select("filepath", "qualified_name", "name", "type", "start_line", "calls", parted.alias("behind"))

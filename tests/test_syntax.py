"""Definitions of five languages, by hand."""

import time

import pytest

from quarryloom.operators.code import source_chunks


def shown(source, language, most=1500):
    return [(r[1], r[2], r[3], r[4], r[5]) for r in source_chunks(source, language, most)]


def test_script_expressions_are_no_definitions_but_hold_some():
    source = """const re = /[/{]"/g, t = `a ${ {b: `}`}.b } {`, f = function named() {};
const g = () => { function deep() { return 1 } };
const o = { run(a) { return a }, b: class Q { m() {} } };
function* gen() { }
if (a) { class In { x() { } } }
"""
    assert shown(source, "javascript") == [
        (2, 2, "function_declaration", "deep", None), (3, 3, "method_definition", "run", None), (3, 3, "method_definition", "m", None), (5, 5, "class_declaration", None, "In"), (5, 5, "method_definition", "x", "In"),
    ]


def test_typescript_members():
    source = """export default async function load<T>(x: T): Promise<{a: T}> {
  function inner() { return '}'; }
}
type A = | 'x'
  | { b: string };
abstract class Base { abstract f(): void; g() { return 1 } }
class Over extends Base<number> implements X {
  static #n = 1;
  private readonly map: Map<string, number> = new Map();
  handle = async (e: Event) => {
    if (e) { return }
  }
  constructor(private a: string) { super() }
  get size(): number { return 1 }
  static async *gen<T>(a: T): { b: T } { }
  foo(a: string): void;
  foo(a: any) { for (const x of a) { } }
  [Symbol.iterator]() { return 1 }
}
"""
    got = shown(source, "tsx")
    assert got[:4] == [(1, 3, "function_declaration", "load", None), (4, 5, "type_alias_declaration", None, "A"), (6, 6, "method_definition", "g", None), (7, 7, "class_declaration", None, "Over")]
    assert [(g[0], g[1], g[3]) for g in got[4:]] == [(8, 8, "#n"), (9, 9, "map"), (10, 12, "handle"), (13, 13, "constructor"), (14, 14, "size"), (15, 15, "gen"), (17, 17, "foo"), (18, 18, "[Symbol.iterator]")]
    assert {g[4] for g in got[4:]} == {"Over"} and [g[2] for g in got[4:7]] == ["property"] * 3


def test_decorators_and_export_belong_to_what_follows():
    source = "\n@Table({\n    tableName: 'activity_logs',\n})\nexport class ActivityLog extends Model {\n    @ForeignKey(() => Group)\n    @Column({ allowNull: false })\n    fileName: string;\n}\n"
    head, field = source_chunks(source, "typescript")
    assert head[0].startswith("@Table({") and "export class ActivityLog" in head[0] and head[5] == "ActivityLog"
    assert field[0] == "@ForeignKey(() => Group)\n    @Column({ allowNull: false })\n    fileName: string" and field[1:3] == (6, 8) and field[4] == "fileName"


def test_java_members():
    source = """package a.b;
/** { */
@Service("x{") @Other({1,2})
public final class A<T extends B> extends C implements D {
  private Map<String, List<Integer>> m = new HashMap<>() {{ put("a", 1); }};
  static { int x = 1; }
  @Autowired public A(int x) throws E { this.m = null; }
  @Override
  public <R> List<R> get(@Nullable String s, int[] y) { char c = '}'; String t = \"\"\"
     " } \"\"\"; return null; }
  abstract void nobody();
  enum E { X { void q() {} }, Y }
  interface In { void call(int x); default int d() { return 1; } }
}
record P(int a) { int sum() { return a; } }
"""
    assert shown(source, "java") == [
        (3, 6, "class_declaration", None, "A"), (7, 7, "constructor_declaration", "A", "A"), (8, 10, "method_declaration", "get", "A"), (11, 11, "method_declaration", "nobody", "A"), (12, 12, "enum_declaration", None, "E"),
        (13, 13, "interface_declaration", None, "In"), (13, 13, "method_declaration", "call", "In"), (13, 13, "method_declaration", "d", "In"), (15, 15, "method_declaration", "sum", None),
    ]


def test_go_and_rust():
    source = 'package main\ntype (\n\tA int\n\tB interface{ F() }\n)\ntype C = map[string]interface{}\nfunc (t *T) Do(a int, f func(int) error) (map[string]interface{}, error) {\n\tx := `raw " {`\n\treturn nil, nil\n}\nfunc Any() interface{} { return struct{}{} }\nfunc G[K comparable](a K) { func() {}() }\n'
    assert shown(source, "golang") == [(2, 5, "type_declaration", None, None), (6, 6, "type_declaration", None, None), (7, 10, "method_declaration", "Do", None), (11, 11, "function_declaration", "Any", None), (12, 12, "function_declaration", "G", None)]
    source = "pub struct P<'a> { x: &'a str }\nstruct U;\nstruct Tup(u8, char);\nimpl<'a, T: Fn(i32) -> i32> fmt::Display for P<'a> where T: X {\n    fn fmt(&self) { let c = '{'; let r = r#\"}\"{\"#; /* a /* } */ { */ }\n}\ntrait Tr { fn sig(&self); fn d(&self) { } }\nmod m { pub fn inside() { } }\nmacro_rules! mac { () => { fn no() {} } }\n"
    assert shown(source, "rs") == [
        (1, 1, "struct_item", None, "P"), (2, 2, "struct_item", None, "U"), (3, 3, "struct_item", None, "Tup"), (4, 4, "impl_item", None, "P<'a>"), (5, 5, "function_item", "fmt", "P<'a>"), (7, 7, "trait_item", None, "Tr"), (8, 8, "function_item", "inside", None),
    ]


def test_what_cannot_be_read_is_text():
    assert [r[7] for r in source_chunks("function a( { \"\n ' \n `", "javascript")] == ["text"]
    assert [r[7] for r in source_chunks("const a = 1;\n", "javascript")] == ["text"] and source_chunks(" \n", "java") == []
    got = source_chunks("func big() {\n" + "\tx := 1\n" * 500 + "}\n", "go", 300)
    assert len(got) > 10 and {(r[3], r[4], r[7]) for r in got} == {("function_declaration", "big", "ast_split")} and all(len(r[0]) <= 300 for r in got) and got[-1][2] == 502


@pytest.mark.parametrize("language", ["javascript", "typescript", "java", "go", "rust"])
def test_odd_sources_take_linear_time(language):
    for part in ("{", '"\n', "/*", "`${", "class A {", "f(){", "@a ", "/ ", "fn a ", "type a\n", "'", "r#\"", "if (a) {}\n"):
        began = time.perf_counter()
        source_chunks(part * (2000 if part == "class A {" else 40_000), language)
        assert time.perf_counter() - began < 20

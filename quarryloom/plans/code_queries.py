"""Queries over source code that holds the documents' texts or is made of their words, and over a stream of deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryloom.operators import code as K
from quarryloom.plans import fixtures as fx
from quarryloom.sources.tables import spread, table
from quarryloom.streaming import deliveries as L


#: Modules of several shapes: language, source (§T: the document's text without quotes and backslashes, §N: its id), and the chunks by hand:
#: (first line, last line, kind, function, class); lines after the text's are counted from its last one.
SHAPES = [
    ("python", 'NOTE = r"""§T"""\n\n\n@register\nclass Model§N(Base):\n    """A model."""\n\n    name: str\n\n    def __init__(self, x):\n        self.total = x\n\n    @property\n    def label(self):\n        return self.name\n\n\ndef helper_§N(a):\n    def inner():\n        return a\n    return inner\n',
     [(4, 9, "class_definition", None, "Model§N"), (10, 11, "function_definition", "__init__", "Model§N"), (13, 15, "function_definition", "label", "Model§N"), (18, 21, "function_definition", "helper_§N", None)]),
    ("javascript", "/* §T */\nexport class Model§N extends Base {\n  constructor(x) {\n    this.total = `${x + `}`} {`;\n  }\n\n  label() {\n    return /[}/\"]/.test(this.name);\n  }\n}\n\nasync function helper_§N(a) {\n  function inner() { return '{'; }\n  return inner;\n}\nconst box = { run_§N() { return 1 } };\n",
     [(2, 2, "class_declaration", None, "Model§N"), (3, 5, "method_definition", "constructor", "Model§N"), (7, 9, "method_definition", "label", "Model§N"), (12, 15, "function_declaration", "helper_§N", None), (16, 16, "method_definition", "run_§N", None)]),
    ("ts", "const note = `§T`;\nexport interface Shape {\n  id: string;\n}\ntype Wide = | 'a'\n  | { b: string };\n@Table({ name: 'x{' })\nexport class Model§N<T> extends Base<T> {\n  @Column({ size: 3 })\n  name: string;\n  private keep = (x: T): void => {\n    x;\n  };\n  async load(x: T): Promise<{ a: T }> {\n    return { a: x };\n  }\n}\nenum Color { Red }\n",
     [(2, 4, "interface_declaration", None, "Shape"), (5, 6, "type_alias_declaration", None, "Wide"), (7, 8, "class_declaration", None, "Model§N"), (9, 10, "property", "name", "Model§N"), (11, 13, "property", "keep", "Model§N"), (14, 16, "method_definition", "load", "Model§N"), (18, 18, "enum_declaration", None, "Color")]),
    ("java", 'package a;\nimport b.C;\n/** §T */\n@Entity(name = "x{")\npublic class Model§N<T extends C> {\n  private String text = "}";\n\n  public Model§N(int x) { this.x = x; }\n\n  @Override\n  public <R> Map<String, R> label(R r, char c) {\n    return c == \'{\' ? null : m;\n  }\n\n  interface Inner { void call(int x); }\n}\nenum Color { RED, GREEN }\n',
     [(4, 7, "class_declaration", None, "Model§N"), (8, 8, "constructor_declaration", "Model§N", "Model§N"), (10, 13, "method_declaration", "label", "Model§N"), (15, 15, "interface_declaration", None, "Inner"), (15, 15, "method_declaration", "call", "Inner"), (17, 17, "enum_declaration", None, "Color")]),
    ("go", "package a\nvar note = `§T`\ntype Model§N struct {\n\tname string\n}\n\nfunc (m *Model§N) Label(f func(int) error) (map[string]interface{}, error) {\n\tr := '{'\n\treturn nil, nil\n}\n\nfunc Any_§N() interface{} { return 1 }\n",
     [(3, 5, "type_declaration", None, None), (7, 10, "method_declaration", "Label", None), (12, 12, "function_declaration", "Any_§N", None)]),
    ("rust", 'const NOTE: &str = r#"§T"#;\n#[derive(Debug)]\npub struct Model§N<\'a> { name: &\'a str }\nimpl<\'a> fmt::Display for Model§N<\'a> {\n    fn fmt(&self) -> fmt::Result { /* { /* */ */ write(\'}\') }\n\n    pub async fn go() -> impl Iterator {\n        fn nested() {}\n    }\n}\nmod m {\n    pub fn inside_§N() {}\n}\n',
     [(3, 3, "struct_item", None, "Model§N"), (4, 4, "impl_item", None, "Model§N<'a>"), (5, 5, "function_item", "fmt", "Model§N<'a>"), (7, 9, "function_item", "go", "Model§N<'a>"), (12, 12, "function_item", "inside_§N", None)]),
    ("js", "function ((( broken_§N {{{\n  return;\n", [(1, 2, "text", None, None)]),
]
#: Lines of a function that is cut: so many and as many as the id's last digits more, all of one length.
LONG, LONG_MORE, LINE = 150, 90, 24


def _clean(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9 \n.,;(){}]", " ")



def _clean(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9 \\n.,;(){}]", " ")


def _sources(spark, sf):
    """A module of one of the shapes for each document; the last shape is a function longer than a chunk."""
    shape, number = (F.col("doc_id") % (len(SHAPES) + 1)).cast("int"), F.col("doc_id").cast("string")
    line = lambda x: F.lit(x.ljust(LINE - 1) + "\n")
    content = F.concat(line("function long_fn() {"), F.repeat(line("  x = x + 1;"), (F.lit(LONG) + F.col("doc_id") % LONG_MORE).cast("int")), F.lit("}\n"))
    language = F.lit("javascript")
    for k, (name, template, _) in enumerate(SHAPES):
        content = F.when(shape == k, F.replace(F.replace(F.lit(template), F.lit("§N"), number), F.lit("§T"), _clean(F.col("text")))).otherwise(content)
        language = F.when(shape == k, name).otherwise(language)
    return table(spark, sf, "documents").select("doc_id", content.alias("content"), language.alias("language"))


def _chunks_sql() -> str:
    """What SHAPES says, with the texts' lines counted; of long functions by closed form."""
    q = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {o}, {a}, {b}, {q(kind)}, {q(f)}, {q(c)}, {int('§T' in template[: 40])})" for k, (_, template, found) in enumerate(SHAPES) for o, (a, b, kind, f, c) in enumerate(found))
    full, step = 1500 // LINE, 1500 // LINE - 150 // LINE
    return f"""WITH d AS (SELECT doc_id, doc_id % {len(SHAPES) + 1} AS k, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 \n.,;(){{}}]', ' ', 'g') AS t FROM documents),
        l AS (SELECT doc_id, k, length(t) - length(replace(t, chr(10), '')) AS lines, {LONG} + doc_id % {LONG_MORE} + 2 AS m FROM d),
        s(k, o, a, b, kind, f, c, moved) AS (VALUES {rows}), parts AS (SELECT doc_id, m, i, 1 + {step} * i AS a FROM l, range(40) r(i) WHERE k = {len(SHAPES)} AND (i = 0 OR m > 1 + {step} * (i - 1) + {full}))
        SELECT doc_id, CAST(o AS INT) AS chunk_ord, CAST(a + lines * moved AS INT) AS start_line, CAST(b + lines * moved AS INT) AS end_line, kind, replace(f, '§N', doc_id::VARCHAR) AS function_name, replace(c, '§N', doc_id::VARCHAR) AS class_name, CASE kind WHEN 'text' THEN 'text' ELSE 'ast' END AS strategy FROM l JOIN s USING (k)
        UNION ALL SELECT doc_id, CAST(i AS INT), CAST(a AS INT), CAST(CASE WHEN m <= a + {full} THEN m ELSE a + {full - 1} END AS INT), 'function_declaration', 'long_fn', NULL, 'ast_split' FROM parts"""


def tf_chunk_ast(spark, sf):
    return K.chunk_sources(_sources(spark, sf)).select("doc_id", "chunk_ord", "start_line", "end_line", "kind", "function_name", "class_name", "strategy")


def _modules(spark, sf):
    """A Python module for each document, made of its words: a class with a member for each, and a mapping or a use for each."""
    member = lambda w: F.concat(F.lit("    f_"), w, F.when(F.length(w) % 2 == 0, ": str\n").otherwise(" = Column(Integer)\n"))
    use = lambda w: F.when(F.length(w) % 3 == 0, F.concat(F.lit("m_"), w, F.lit(" = fields.Str(required=True, attribute=\"f_"), w, F.lit("\")\n"))).otherwise(F.concat(F.lit("print("), F.lit("r_"), w, F.lit(".phone_number)\n")))
    head = F.array(F.concat(F.lit("class Model"), F.col("doc_id").cast("string"), F.lit("(Base):\n")))
    module = lambda words: F.array_join(F.concat(head, F.transform(words, member), F.array(F.lit("    @property\n    def label(self):\n        return self.name\n\n")), F.transform(words, use)), "")
    words = F.sort_array(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{4,}"), F.lit(0))))
    # the words are bound once through a one-element array
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.element_at(F.transform(F.array(words), module), 1).alias("content"))


def tf_class_models(spark, sf):
    return K.class_models(_modules(spark, sf), key="doc_id")


def tf_schema_refs(spark, sf):
    return K.schema_references(_modules(spark, sf), key="doc_id", field="phone_number")


def srch_contract(spark, sf):
    s = _modules(spark, sf)
    return K.contract(K.class_models(s, key="doc_id", named="Model7"), K.schema_references(s, key="doc_id", field="phone_number"), key="doc_id", class_name="Model7", field="phone_number").select("class_name", "field", "issue", F.col("classes").cast("long").alias("classes"), "uses")


def stream_deliveries(spark, sf):
    """The deliveries, each once, routed by a stream that runs until its input is read; the result is what its batches wrote."""
    import tempfile
    import uuid

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp()}"
    where = f"{shared.rstrip('/')}/deliveries-{uuid.uuid4().hex}"
    fx.deliveries(spark, sf).select("delivery_id", "received_at", "event_type", "github_repo_id", "ref", "payload").write.parquet(f"{where}/in")
    stream = L.routed(L.once(L.read(spark, f"{where}/in")), fx.repos(spark, sf))
    L.run(stream, L.append_batches(f"{where}/out"), f"{where}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{where}/out").select("delivery_id", "outcome", "repo_id")


QUERIES = {f.__name__: f for f in (tf_chunk_ast, tf_class_models, tf_schema_refs, srch_contract, stream_deliveries)}

_WORDS = """w AS (SELECT doc_id, x.w, row_number() OVER (PARTITION BY doc_id ORDER BY x.w) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[a-z]{4,}'))) AS w FROM documents) x)"""

ORACLE_SQL = {
    "tf_chunk_ast": _chunks_sql(),
    "tf_class_models": f"""WITH {_WORDS} SELECT doc_id, 'Model' || doc_id AS class_name, 'f_' || w AS member, CASE WHEN length(w) % 2 = 0 THEN 'field' ELSE 'column' END AS kind, CAST(1 + i AS INT) AS line FROM w
        UNION ALL SELECT d.doc_id, 'Model' || d.doc_id, 'label', 'property', CAST(3 + coalesce(max(n), 0) AS INT) FROM documents d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id""",
    "tf_schema_refs": f"""WITH {_WORDS} SELECT doc_id, CAST(1 + n + 4 + i AS INT) AS line, CASE WHEN length(w) % 3 = 0 THEN 'mapping' ELSE 'field_access' END AS kind, CASE WHEN length(w) % 3 = 0 THEN 'm_' ELSE 'r_' END || w AS name, CASE WHEN length(w) % 3 = 0 THEN 'f_' || w ELSE 'phone_number' END AS target FROM w""",
    "srch_contract": f"""WITH {_WORDS}, own AS (SELECT w FROM w WHERE doc_id = 7), f AS (SELECT count(*) FILTER (length(w) % 3 <> 0) AS uses, count(*) FILTER (length(w) % 3 = 0 AND w NOT IN (SELECT w FROM own)) AS strange FROM w)
        SELECT 'Model7' AS class_name, 'phone_number' AS field, CASE WHEN strange > 0 THEN 'FIELD_MAPPING_MISMATCH' ELSE 'MODEL_FIELD_MISSING' END AS issue, CAST(1 AS BIGINT) AS classes, uses FROM f""",
    "stream_deliveries": f"""WITH {fx.DELIVERIES_SQL}, {fx.REPOS_SQL}, r AS (SELECT o.delivery_id, event_type, repo_id, event_type = 'push' AND repo_id IS NOT NULL AND ref = 'refs/heads/' || default_branch AS good FROM once o LEFT JOIN repos USING (github_repo_id))
        SELECT delivery_id, CASE WHEN event_type = 'ping' THEN 'ok' WHEN good THEN 'accepted' ELSE 'ignored' END AS outcome, CASE WHEN good THEN repo_id END AS repo_id FROM r""",
}

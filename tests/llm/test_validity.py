import ast
import glob
import json
import os
import random
import sys
import sysconfig
import tomllib
import warnings

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import validity
from graphloom.llm.parsing import go, json_, python_, rust, sql, toml_, typescript

VALID = {
    "rs": [
        "", "#![allow(x)]\nfn main() { println!(\"{}\", 1); }", "pub struct A<'a, T: Clone + 'a>(&'a T, Vec<Vec<u8>>) where T: Copy;", "impl<T> Iterator for B<T> { type Item = T; fn next(&mut self) -> Option<T> { None } }",
        "fn f() { let x = if a { 1 } else { 2 }; match x { 1 | 2 => (), n if n > 3 => { g() } _ => h(), } }", "fn f() { let v: Vec<_> = (0..10).map(|x| x * 2).collect::<Vec<i32>>(); for (i, x) in v.iter().enumerate() { } }",
        "fn f() { let s = r#\"a \"quoted\" <<<<<<< x\"#; let c = '\\''; let b = b\"x\"; /* a /* nested */ b */ }", "macro_rules! m { ($x:expr) => { $x }; }\nm!(1);", "const X: [u8; 3] = [1, 2, 3]; static mut Y: u32 = 0x1F_u32;",
        "fn f(x: &dyn Fn(u8) -> u8, y: impl Trait + 'static) -> Result<(), Box<dyn Error>> { Ok(x(1)?) }", "enum E { A = 1, B(u8), C { x: u8 } }", "async fn f() { g().await; let Some(x) = y else { return; }; }", "fn f() { S { a, b: 1, ..Default::default() }; if x == (S { a: 1 }) {} }",
        "fn f() { let x = (a as u8) < b; let y = &mut *z; let w = 1..=2; 'l: loop { break 'l; } }", "union U { a: u8 }", "fn f() { if let Some(x) = y && z { } while let Ok(v) = g() {} }", "unsafe extern \"C\" { fn f(x: u8, ...); }",
    ],
    "go": [
        "package a\n", "package a\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\nvar a, b = 1, 2\nconst (\n\tA = iota\n\tB\n)\n", "package a\ntype T[K comparable, V any] struct {\n\tm map[K]V\n\tx, y int `json:\"x\"`\n\t*E\n}\n",
        "package a\nfunc (t *T) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[1]; ok {\n\t\treturn v, nil\n\t} else if x {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor range ch {\n\t}\n\tswitch y := x.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tdefer func() { recover() }()\n\treturn\n}\n",
        "package a\nfunc f() {\n\tx := []int{1, 2}\n\ty := map[string][]T{\"a\": {{1}}}\n\tz := &T{a: 1}\n\tselect {\n\tcase v := <-c:\n\tcase c <- 1:\n\t}\n\tgo g()\nL:\n\tfor {\n\t\tbreak L\n\t}\n\t_ = x[1:2]\n\t_ = func(a int) int { return a }\n\t_, _ = y, z\n}\n",
        "package a\ntype I interface {\n\tF(int) error\n\tJ\n\t~int | string\n}\nvar s = `raw { ` + \"x\" + 'c'\n",
    ],
    "ts": [
        "", "import a, { b as c, type D } from \"x\";\nexport * from './y'\nexport default class extends A<B> implements C {}", "const f = async <T,>(x: T, ...r: number[]): Promise<T> => { await g(x) }", "let x = a < b ? (c) : d, y = a ? (b) : (c) => d",
        "type A<T> = T extends (infer U)[] ? U : { readonly [K in keyof T]?: T[K] } | `a${string}`", "interface I { (x: number): void; new (y: string): I; [k: string]: any; m?<T>(a?: T): asserts a is T }", "class A { private x: number[] = []; static { } get y() { return 1 } async *z<T>() { yield* a } #p = 1; constructor(private readonly q: string) { super() } }",
        "for (const [a, b] of c) { } for (let i = 0, n = 3; i < n; i++); for (const k in o) {}", "const t = `a ${b + `c ${d}`} <<<<<<< e`; const r = /[/\\]]+/g.test(s); x = y / z / w", "enum E { A, B = 'x' }\ndeclare module 'm' { export const v: string }\nnamespace N.M { }",
        "switch (a) { case 1: default: b() }\ntry { } catch { } finally { }\ndo { } while (x)\nlabel: while (1) { break label }", "const o = { a, 'b': 1, [c]: 2, ...d, async f() {}, get g() { return 1 } }; f<number>(1); a?.b?.[c]?.(d)!; x ??= y as unknown as Z", "abstract class B { abstract f(): void }\nexport type { T } from 'x'",
        "function f(this: A, x: number): x is B\nfunction f(a) { return a >>> 1 >> 2 >= 3 }", "@d() class C { @p x = 1 }", "let a = <T>b; let fn: (a: number) => void = (a) => {}",
    ],
    "sql": [
        "", "SELECT 1", "select a.b, count(*) filter (where x > 1) over (partition by y order by z desc nulls last rows between 1 preceding and current row) from t as q left join u using (id) where a in (select 1) and not exists (select 2) group by 1 having sum(x) > 2 order by 1 limit 5 offset 2;",
        "CREATE TABLE t (a INTEGER PRIMARY KEY, b VARCHAR(80) DEFAULT 'it''s (', c NUMERIC(10, 2) NOT NULL CHECK (c >= 0), FOREIGN KEY (a) REFERENCES u (x) ON DELETE CASCADE); -- x (\nINSERT INTO t (a, b) VALUES (1, 'x'), (2, NULL) ON CONFLICT (a) DO UPDATE SET b = excluded.b RETURNING a",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT CASE WHEN n = 1 THEN 'a' ELSE 'b' END, CAST(n AS TEXT), n::int, date '2020-01-01', x BETWEEN 1 AND 2, y IS NOT NULL, z NOT LIKE '%a' FROM r", "UPDATE t SET a = 1, b = DEFAULT WHERE c = $1; DELETE FROM t; DROP TABLE IF EXISTS t; ALTER TABLE t ADD COLUMN d TIMESTAMP WITH TIME ZONE;",
        "CREATE UNIQUE INDEX i ON t (lower(a), b DESC) WHERE c > 0; CREATE OR REPLACE VIEW v AS SELECT * FROM t; BEGIN; COMMIT;",
    ],
}
INVALID = {
    "rs": ["fn f( {", "struct A { x u8 }", "fn f() { let = 1; }", "fn f() {\n<<<<<<< HEAD\n}", "import json", "fn f() { a b }", "fn f() { \"open }", "fn f() { 1 < 2 < 3; }", "}", "fn f() { match x { 1 => } }", "{\"a\": 1}", "fn f() { /* open }"],
    "go": ["", "package a\nfunc f( {\n}\n", "package a\nfunc f() {\n\tif x \n\t{\n\t}\n}\n", "package a\nfunc f() {\n=======\n}\n", "import \"fmt\"\n", "package a\nfunc f() { x := }\n", "package a\nvar s = \"open\n", "package a\nfunc f() {", "package a\nx = 1\n"],
    "ts": ["const = 1", "function f( {", "<<<<<<< HEAD\nlet a = 1", "let a = `open ${x", "class A { x: }", "if (a {", "import { a from 'x'", "let x = 'open", "def f(x):\n  return 1", "{\"a\": 1, \"b\": 2}", "a b", "let f = (a, b => a", "}", "interface I { x: string"],
    "sql": ["SELECT", "SELECT a FROM", "CREATE TABLE t (a INTEGER,)", "SELECT 1 SELECT 2", "INSERT INTO t VALUES (1", "SELECT 'open", "<<<<<<< HEAD\nSELECT 1", "def f(): pass", "SELECT a b c FROM t", "CREATE TABLE t a INTEGER", "SELECT (1", "UPDATE t WHERE x = 1", "/* open"],
}
CHECK = {"rs": rust.check, "go": go.check, "ts": typescript.check, "sql": sql.check}


@pytest.mark.parametrize("ending", sorted(CHECK))
def test_valid_and_invalid_texts(ending):
    for text in VALID[ending]:
        assert not CHECK[ending](text), text
        assert not CHECK[ending](text.replace("\n", "\r\n")), text
    for text in INVALID[ending]:
        assert CHECK[ending](text), text


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4)), st.integers(0, 10**6), st.booleans())
def test_json_equals_the_standard_parser(value, at, broken):
    text = json.dumps(value, ensure_ascii=False, indent=at % 3)
    if broken and text:
        i = at % len(text)
        text = text[:i] + text[i + 1 :]
    try:
        json.loads(text, parse_constant=lambda x: 1 / 0)
        ok = True
    except (ValueError, ZeroDivisionError):
        ok = False
    assert (not json_.check(text)) == ok


TOML = [
    "a = 1\nb.c = 'x'\n[t]\nd = [1, 2,\n 3, # c\n]\n[[l]]\nx = {y = 1, z.w = 2}\n[[l]]\n[l.m]\n", 'a = """\nx\\\n  y"""\nb = 1979-05-27T07:32:00Z\nc = 1_000.5e3\nd = inf\n"q k" = 0xff\n', "a = 1\na = 2\n", "[t]\n[t]\n", "a = 'x\n", "a = 01\n", "a 1\n", "[t\n", "a = {b = 1,}\n", "a = [1 2]\n", "a.b = 1\na = 2\n", "a = 1 b = 2\n", "", "# c", "a = \"\\q\"", "[a]\n[a.b]\n[a]\n", "a = true\r\n",
]


def test_toml_equals_the_standard_parser():
    r = random.Random(1)
    for text in TOML + [t[:i] + c + t[i + 1 :] for t in TOML for i, c in ((r.randrange(len(t) + 1), r.choice("=[]\"'\n.,#x 1")) for _ in range(60))]:
        try:
            tomllib.loads(text)
            ok = True
        except ValueError:
            ok = False
        assert (not toml_.check(text)) == ok, repr(text)


def test_python_equals_the_compiler_on_its_own_library():
    warnings.simplefilter("ignore")
    sys.setrecursionlimit(20_000)
    r = random.Random(2)
    names = sorted(glob.glob(os.path.join(sysconfig.get_path("stdlib"), "*.py")))
    for name in r.sample(names, 30):
        source = open(name, encoding="utf-8").read()[:60_000]
        i = r.randrange(len(source))
        for text in (source, source[:i], source[:i] + source[i + 1 :]):
            try:
                ast.parse(text)
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            assert (not python_.check(text)) == ok, (name, i)


PYTHON = [
    "f'{x!r:>{w}} {{}} {a[\"b\"]}'", "f'{x'", "f'{}'", "match x:\n case [1, *r] if r: pass\n case {'a': b, **c} | None: pass\n case P(x, y=2): pass\n", "match = 1; type = 2; type X = int", "def f(a, /, b=1, *, c, **d): pass", "def f(a=1, b): pass", "f(x for x in y)", "f(a, x for x in y)",
    "f(a=1, 2)", "(yield)", "a = b = *c, d", "1 = x", "x += y = 2", "(a, b) += 1", "x: int = 3", "[a, b]: int", "with (open(a) as b, c): pass", "with (a): pass", "try:\n x\nexcept* A as e: pass\n", "try: x", "async def f():\n async with a as b, c: await d\n", "if x:\nreturn", " x = 1", "if x:\n  a\n b", "if x:\n\ta\n        b",
    "@a.b(c)\ndef f(): ...", "@a\nx = 1", "lambda *a, b=1, **c: (a, b)", "print 'x'", "x = 0777", "1_0.5e-3j", "b'é'", "'\\N{dash}' '\\x4'", "a if b", "not in x", "a not b", "{**a, 'b': 1}", "{1, **a}", "{a: b for a in c}", "[*a for a in b]", "del (a, b), c[0]", "del f()", "from . import (a, b,)", "from a import b,", "import a.b as c, d", "x = yield", "(x := 1)", "x := 1",
    "global a, b", "a[1:2, ::3, *b]", "raise A from B", "assert x, y", "while x: pass\nelse: pass", "class A[T: int, *U](B, metaclass=C): pass", "a\\\n + b", "'''open", "\"a\nb\"", "def f():\n", "x = (1,\n 2", "()()", "a.1", "for x in *a, b: pass", "for f() in x: pass", "return", "", "\n\n# only\n", "<<<<<<< HEAD\nx = 1\n=======\n", "é = 1", "$x", "x = 1;; y", "x = 1;",
]


@pytest.mark.parametrize("text", PYTHON)
def test_python_equals_the_compiler_on_cases(text):
    warnings.simplefilter("ignore")
    try:
        ast.parse(text)
        ok = True
    except (SyntaxError, ValueError):
        ok = False
    assert (not python_.check(text)) == ok


def test_recovery_reports_more_than_one_error():
    got = rust.check("fn a() { let = 1; }\nfn b() {}\nfn c( { }\nfn d() {}\n")
    assert len(got) >= 2 and got[0].line == 1 and got[-1].line >= 3


def test_files_rates_and_causes(spark):
    data = [
        ("r/a.py", "x = 1"), ("r/a.py", "x = 1"), ("r/b.py", "x ="), ("r/c.py", None), ("r/d.py", ""), ("q/e.json", ""), ("q/f.json", "{}"), ("q/g.md", "<<<<<<<"), ("q/h.bin", "?"), (None, "x"), ("q/i.rs", "fn f() {}" * 2000), ("q/j.json", "[" * 50_000), ("r/k.PY", "x ="),
    ]
    df = spark.createDataFrame([(*x, "z") for x in data], "path string, content string, language string")
    assert rows(validity.invalid_files(df), "path") == [("q/e.json",), ("q/j.json",), ("r/b.py",), ("r/k.PY",)]
    assert rows(validity.rates(df), "repo", "language", "n_files", "n_judged", "n_invalid") == sorted([("q", "json", 3, 3, 2), ("q", "markdown", 1, 1, 0), ("q", "rust", 1, 1, 0), ("q", None, 1, 0, 0), ("r", "python", 5, 4, 2)], key=repr)
    assert validity.invalid_files(df.limit(0)).count() == 0 and validity.causes(df).count() > 0


FURTHER_SQL = [
    "MERGE INTO t AS a USING (SELECT 1 AS x) s ON a.x = s.x WHEN MATCHED AND a.y > 1 THEN UPDATE SET y = s.x, z = DEFAULT WHEN NOT MATCHED THEN INSERT (x, y) VALUES (s.x, 2) WHEN NOT MATCHED BY SOURCE THEN DELETE;",
    "CALL refresh(1, 'x'); CALL s.p();", "COPY t (a, b) FROM 'f.csv' WITH (FORMAT csv, HEADER true, DELIMITER ','); COPY (SELECT 1) TO STDOUT; COPY t FROM STDIN CSV HEADER;",
    "BEGIN; SAVEPOINT a; ROLLBACK TO SAVEPOINT a; RELEASE SAVEPOINT a; COMMIT; START TRANSACTION READ ONLY; BEGIN ISOLATION LEVEL REPEATABLE READ; ROLLBACK;",
    "CREATE TRIGGER g BEFORE INSERT OR UPDATE OF a, b ON t FOR EACH ROW WHEN (new.a > 1) EXECUTE FUNCTION f('x');", "CREATE TRIGGER IF NOT EXISTS g AFTER DELETE ON t BEGIN INSERT INTO log VALUES (old.a); DELETE FROM u WHERE a = old.a; END;",
    "CREATE OR REPLACE FUNCTION f(a int, INOUT b text DEFAULT 'x', double precision) RETURNS TABLE (c int, d text) LANGUAGE plpgsql STABLE STRICT AS $$ BEGIN not sql at all ( END $$;", "CREATE FUNCTION g() RETURNS trigger AS $body$ x $body$ LANGUAGE plpgsql", "CREATE FUNCTION h(x int) RETURNS int RETURN x + 1",
    "CREATE PROCEDURE p(a int) LANGUAGE sql BEGIN ATOMIC INSERT INTO t VALUES (a); END", "SELECT * FROM t TABLESAMPLE BERNOULLI (10) REPEATABLE (3) JOIN u x TABLESAMPLE (5 PERCENT) ON t.a = x.a",
    "DO $$ anything $$", "DROP FUNCTION IF EXISTS f(int, text) CASCADE; DROP TRIGGER g ON t; TRUNCATE t, u RESTART IDENTITY CASCADE; REFRESH MATERIALIZED VIEW v; CREATE SEQUENCE q START WITH 1 INCREMENT BY -2 NO CYCLE OWNED BY t.a", "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY a) FROM t",
]
BROKEN_SQL = ["MERGE INTO t USING s ON a = b", "MERGE INTO t USING s WHEN MATCHED THEN DELETE", "CALL f", "COPY t 'x'", "SAVEPOINT", "CREATE TRIGGER g BEFORE ON t EXECUTE FUNCTION f()", "CREATE TRIGGER g AFTER DELETE ON t BEGIN DELETE FROM u END", "CREATE FUNCTION f( RETURNS int AS 'x'", "CREATE FUNCTION f() RETURNS int", "CREATE FUNCTION f() RETURNS int AS x", "SELECT * FROM t TABLESAMPLE BERNOULLI"]


@pytest.mark.parametrize("text", FURTHER_SQL)
def test_further_sql_statements(text):
    assert sql.check(text) == []


@pytest.mark.parametrize("text", BROKEN_SQL)
def test_broken_further_sql_statements(text):
    assert sql.check(text)


DEEP = {"rs": "fn f() {{ let x = {}1{}; }}", "go": "package a\nvar x = {}1{}\n", "ts": "let x = {}1{};", "sql": "SELECT {}1{}"}


@pytest.mark.parametrize("ending", sorted(DEEP))
def test_depth_does_not_make_a_valid_text_invalid(ending):
    n = 20_000
    assert validity.issues("a." + ending, DEEP[ending].format("(" * n, ")" * n)) == []
    assert validity.issues("a." + ending, DEEP[ending].format("(" * n, ")" * (n - 1)))


def test_json_nests_to_any_depth_and_keeps_all_errors():
    n = 1_000_000
    assert validity.issues("a.json", "[" * n + "]" * n) == []
    assert len(validity.issues("a.json", "[" * n + "]" * (n - 1))) == 1
    assert len(validity.issues("a.json", "@ " * 5000)) >= 5000
    got = validity.issues("a.json", "{\n" + '"a" 1,\n' * 3000 + '"b": 2}')
    assert {x.line for x in got} == set(range(2, 3002))
    assert len(validity.issues("a.json", "[1 2, , }] 3")) >= 4


def test_what_nests_too_deeply_is_not_judged(spark, monkeypatch):
    def deep(source):
        raise RecursionError

    monkeypatch.setattr(validity, "CHECKS", validity.CHECKS | {"rs": deep})
    assert validity.issues("a.rs", "fn f() {}") is None

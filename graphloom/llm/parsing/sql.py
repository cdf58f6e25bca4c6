"""SQL, several statements allowed."""

from __future__ import annotations

import re

from graphloom.llm.parsing.base import Parser, SyntaxIssue, scan

_TOKEN = re.compile(
    r"""(?P<ws>\s+)
    |(?P<com>--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<str>(?:[eEbBxXnN](?='))?'(?:[^']|'')*')
    |(?P<dollar>\$(?P<tag>[A-Za-z_]\w*)?\$.*?\$(?(tag)(?P=tag))\$)
    |(?P<quoted>"(?:[^"]|"")+"|`[^`]+`)
    |(?P<num>(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)(?![A-Za-z_]))
    |(?P<param>\?|\$\d+|[:@][A-Za-z_]\w*)
    |(?P<id>[^\W\d]\w*)
    |(?P<op>->>|->|<=>|::|:=|<>|!=|<=|>=|==|\|\||&&|<<|>>|!~\*?|~\*|[-+*/%=<>(),.;\[\]{}:&|^~])""",
    re.X | re.S,
)
# Words that can't be a plain name.
_RESERVED = frozenset(
    "ALL ALTER AND ANY AS ASC BEGIN BETWEEN BY CASE CAST CHECK COLLATE COMMIT CONSTRAINT CREATE CROSS DEFAULT DELETE DESC DISTINCT DROP ELSE END EXCEPT EXISTS FETCH FOR FOREIGN FROM FULL GRANT GROUP HAVING IN INNER INSERT INTERSECT INTO IS JOIN LEFT LIKE ILIKE LIMIT NATURAL NOT NULL OFFSET ON OR ORDER OUTER PRIMARY REFERENCES RETURNING REVOKE RIGHT ROLLBACK SELECT SET SOME TABLE THEN TO UNION UNIQUE UPDATE USING VALUES WHEN WHERE WINDOW WITH".split()
)
_START = frozenset(["SELECT", "INSERT", "CREATE", "DROP", "ALTER", "UPDATE", "DELETE"])
_PLACES = ("BEFORE", "AFTER", "INSTEAD")
_LEVEL = {
    "OR": 1, "AND": 2, "IS": 4, "IN": 4, "LIKE": 4, "ILIKE": 4, "BETWEEN": 4, "NOT": 4, "=": 4, "==": 4, "<>": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "<=>": 4, "~": 4, "~*": 4, "!~": 4, "!~*": 4,
    "|": 5, "&": 5, "<<": 5, ">>": 5, "||": 6, "->": 6, "->>": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8, "^": 9, "COLLATE": 10, "::": 11,
}


class Sql(Parser):
    RESUME = _START

    def __init__(self, source: str) -> None:
        tokens = scan(source, _TOKEN, frozenset())
        for i, kind in enumerate(tokens.kind):
            if kind == "id" and (word := tokens.text[i].upper()) in _RESERVED:
                tokens.kind[i] = word
            elif kind in ("quoted",):
                tokens.kind[i] = "id"
            elif kind == "dollar":
                tokens.kind[i] = "str"
        super().__init__(source, tokens)

    def word(self, *words: str) -> bool:
        """Whether the next token is one of the words, reserved or not."""
        return self.k[self.i] not in ("str", "num") and self.t[self.i].upper() in words

    def take(self, *words: str) -> bool:
        """The words one after another, or none of them."""
        for n, w in enumerate(words):
            j = self.i + n
            if j >= len(self.k) or self.k[j] == "str" or self.t[j].upper() != w:
                return False
        self.i += len(words)
        return True

    def need(self, *words: str) -> None:
        if not self.take(*words):
            self.fail("expected " + " ".join(words))

    def name(self) -> None:
        self.expect("id")
        while self.accept("."):
            self.expect("id")

    def names(self) -> None:
        self.expect("(")
        self.listed(self.name)
        self.expect(")")

    def listed(self, item) -> None:
        item()
        while self.accept(","):
            item()

    def script(self) -> None:
        while not self.at("eof"):
            if self.accept(";"):
                continue
            self.guarded(self.terminated)

    def terminated(self) -> None:
        self.statement()
        if not self.at("eof"):
            self.expect(";")

    def statement(self) -> None:
        if self.word("SELECT", "WITH", "VALUES", "FROM") or self.at("("):
            self.with_query()
        elif self.take("INSERT") or self.take("REPLACE"):
            self.insert()
        elif self.take("UPDATE"):
            self.update()
        elif self.take("DELETE"):
            self.delete()
        elif self.take("CREATE"):
            self.create()
        elif self.take("MERGE"):
            self.merge()
        elif self.take("DROP"):
            self.kind_of_object()
            self.take("CONCURRENTLY")
            self.take("IF", "EXISTS")
            self.listed(self.dropped)
            if self.take("ON"):
                self.name()
            self.take("CASCADE") or self.take("RESTRICT")
        elif self.take("ALTER"):
            self.alter()
        elif self.take("TRUNCATE"):
            self.take("TABLE")
            self.listed(self.name)
            self.take("RESTART", "IDENTITY") or self.take("CONTINUE", "IDENTITY")
            self.take("CASCADE") or self.take("RESTRICT")
        elif self.take("CALL"):
            self.name()
            self.arguments()
        elif self.take("COPY"):
            self.copy()
        elif self.take("SAVEPOINT"):
            self.expect("id")
        elif self.take("RELEASE"):
            self.take("SAVEPOINT")
            self.expect("id")
        elif self.take("ROLLBACK", "TO") or self.take("ROLLBACK", "TRANSACTION", "TO") or self.take("ROLLBACK", "WORK", "TO"):
            self.take("SAVEPOINT")
            self.expect("id")
        elif self.take("DO"):
            if self.take("LANGUAGE"):
                self.expect("id")
            self.expect("str")
        elif self.take("USE"):
            self.name()
        elif self.take("REFRESH", "MATERIALIZED", "VIEW"):
            self.take("CONCURRENTLY")
            self.name()
        elif self.take("PREPARE"):
            self.expect("id")
            if self.accept("("):
                self.listed(self.type_name)
                self.expect(")")
            self.need("AS")
            self.statement()
        elif self.take("EXECUTE"):
            self.expect("id")
            if self.at("("):
                self.arguments()
        elif self.take("TABLE"):
            self.name()
        elif self.take("EXPLAIN"):
            self.take("ANALYZE")
            self.take("QUERY", "PLAN")
            self.statement()
        elif self.take("BEGIN") or self.take("START", "TRANSACTION") or self.take("COMMIT") or self.take("ROLLBACK") or self.take("END"):
            self.take("DEFERRED") or self.take("IMMEDIATE") or self.take("EXCLUSIVE")
            self.take("TRANSACTION") or self.take("WORK")
            if self.take("ISOLATION", "LEVEL"):
                self.take("SERIALIZABLE") or self.take("REPEATABLE", "READ") or self.take("READ", "COMMITTED") or self.need("READ", "UNCOMMITTED")
            self.take("READ", "ONLY") or self.take("READ", "WRITE")
        elif self.take("GRANT") or self.take("REVOKE"):
            self.listed(self.privilege)
            self.need("ON")
            self.take("TABLE")
            self.name()
            self.take("TO") or self.need("FROM")
            self.listed(self.name)
        elif self.take("SET") or self.take("PRAGMA"):
            self.name()
            if self.accept("=") or self.take("TO"):
                self.listed(self.expression)
            elif self.accept("("):
                self.listed(self.expression)
                self.expect(")")
        elif self.take("ANALYZE") or self.take("VACUUM"):
            if self.at("id"):
                self.name()
        elif self.take("COMMENT", "ON"):
            self.kind_of_object()
            self.name()
            self.take("IS") and self.expression()
        else:
            self.fail("statement expected")

    def privilege(self) -> None:
        if not (self.take("ALL", "PRIVILEGES") or self.take("ALL")):
            self.skip()

    def kind_of_object(self) -> None:
        self.take("MATERIALIZED")
        if not any(self.take(w) for w in ("TABLE", "VIEW", "INDEX", "SCHEMA", "SEQUENCE", "TYPE", "TRIGGER", "FUNCTION", "PROCEDURE", "DATABASE", "COLUMN", "EXTENSION", "ROLE", "USER")):
            self.fail("kind of object expected")

    def dropped(self) -> None:
        self.name()
        if self.accept("("):  # the arguments of a function
            if not self.at(")"):
                self.listed(self.parameter)
            self.expect(")")

    def merge(self) -> None:
        """MERGE after its first word."""
        self.need("INTO")
        self.name()
        if not self.at("USING"):
            self.alias()
        self.need("USING")
        self.table_primary()
        self.need("ON")
        self.expression()
        if not self.at("WHEN"):
            self.fail("expected WHEN")
        while self.take("WHEN"):
            self.take("NOT")
            self.need("MATCHED")
            if self.take("BY"):
                self.take("SOURCE") or self.need("TARGET")
            if self.take("AND"):
                self.expression()
            self.need("THEN")
            if self.take("UPDATE"):
                self.need("SET")
                self.listed(self.assignment)
            elif self.take("INSERT"):
                if self.at("("):
                    self.names()
                if not self.take("DEFAULT", "VALUES"):
                    self.need("VALUES")
                    self.row()
            elif not self.take("DELETE"):
                self.need("DO", "NOTHING")
        self.returning()

    def copy(self) -> None:
        """COPY after its first word."""
        if self.accept("("):
            self.statement()
            self.expect(")")
        else:
            self.name()
            if self.at("("):
                self.names()
        self.take("TO") or self.need("FROM")
        if not self.accept("str"):
            self.expect("id")
        self.take("WITH")
        if self.accept("("):
            self.listed(self.option)
            self.expect(")")
        while self.at("id", "NULL"):
            self.option()
        if self.take("WHERE"):
            self.expression()

    def option(self) -> None:
        """A word, and the value it may have."""
        self.skip()
        self.take("AS")
        if self.at("("):
            self.names()
        elif self.at("str", "num", "id", "NULL"):
            self.skip()

    def parameter(self) -> None:
        """A parameter of a function: mode, name, type and default, of which only the type must be there."""
        self.take("INOUT") or self.take("OUT") or self.take("VARIADIC") or self.take("IN")
        self.type_name()
        if self.at("id"):
            self.type_name()
        if self.take("DEFAULT") or self.accept("="):
            self.expression()

    def function(self) -> None:
        """CREATE FUNCTION or PROCEDURE after these words."""
        self.name()
        self.expect("(")
        if not self.at(")"):
            self.listed(self.parameter)
        self.expect(")")
        if self.take("RETURNS"):
            if self.take("TABLE"):
                self.expect("(")
                self.listed(self.parameter)
                self.expect(")")
            else:
                self.take("SETOF")
                self.type_name()
        body = False
        while not self.at("eof", ";"):
            if self.take("AS"):
                self.expect("str")
                if self.accept(","):
                    self.expect("str")
                body = True
            elif self.take("RETURN"):
                self.expression()
                body = True
            elif self.take("BEGIN", "ATOMIC") or self.take("BEGIN"):
                self.block()
                body = True
            elif self.take("LANGUAGE"):
                self.accept("str") or self.expect("id")
            elif self.take("SET"):
                self.name()
                self.accept("=") or self.need("TO")
                self.listed(self.expression)
            elif self.take("COST") or self.take("ROWS"):
                self.expect("num")
            elif self.take("NOT"):
                self.need("DETERMINISTIC") if self.word("DETERMINISTIC") else self.need("LEAKPROOF")
            elif self.take("CALLED", "ON", "NULL", "INPUT") or self.take("RETURNS", "NULL", "ON", "NULL", "INPUT") or self.take("PARALLEL"):
                if self.word("SAFE", "UNSAFE", "RESTRICTED"):
                    self.skip()
            elif not any(self.take(w) for w in ("IMMUTABLE", "STABLE", "VOLATILE", "STRICT", "LEAKPROOF", "DETERMINISTIC")) and not self.take("SECURITY", "DEFINER") and not self.take("SECURITY", "INVOKER"):
                self.fail("option of a function expected")
        if not body:
            self.fail("body expected")

    def block(self) -> None:
        """Statements up to END."""
        while not self.take("END"):
            if self.take("RETURN"):
                self.expression()
            else:
                self.statement()
            self.expect(";")

    def trigger(self) -> None:
        """CREATE TRIGGER after these words."""
        self.take("IF", "NOT", "EXISTS")
        self.name()
        if self.word(*_PLACES):
            self.take("INSTEAD", "OF") or self.skip()
        while True:
            if self.take("UPDATE"):
                if self.take("OF"):
                    self.listed(self.name)
            elif not (self.take("INSERT") or self.take("DELETE") or self.take("TRUNCATE")):
                self.fail("event expected")
            if not self.take("OR"):
                break
        self.need("ON")
        self.name()
        if self.take("REFERENCING"):
            while self.word("OLD", "NEW"):
                self.skip()
                self.need("TABLE")
                self.take("AS")
                self.expect("id")
        if self.take("FOR"):
            self.take("EACH")
            self.take("ROW") or self.need("STATEMENT")
        if self.take("WHEN"):
            self.expression()
        if self.take("BEGIN"):
            return self.block()
        self.need("EXECUTE")
        self.take("FUNCTION") or self.need("PROCEDURE")
        self.name()
        self.arguments()

    def with_query(self) -> None:
        if self.take("WITH"):
            self.take("RECURSIVE")
            self.listed(self.common_table)
            if self.take("INSERT"):
                return self.insert()
            if self.take("UPDATE"):
                return self.update()
            if self.take("DELETE"):
                return self.delete()
        self.query()

    def common_table(self) -> None:
        self.expect("id")
        if self.at("("):
            self.names()
        self.need("AS")
        self.take("NOT", "MATERIALIZED") or self.take("MATERIALIZED")
        self.expect("(")
        self.statement()
        self.expect(")")

    def query(self) -> None:
        self.query_term()
        while self.take("UNION") or self.take("EXCEPT") or self.take("INTERSECT"):
            self.take("ALL") or self.take("DISTINCT")
            self.query_term()
        if self.take("ORDER", "BY"):
            self.listed(self.order_item)
        while self.word("LIMIT", "OFFSET", "FETCH", "FOR"):
            if self.take("LIMIT"):
                self.take("ALL") or self.listed(self.expression)
            elif self.take("OFFSET"):
                self.expression()
                self.take("ROWS") or self.take("ROW")
            elif self.take("FETCH"):
                self.take("FIRST") or self.need("NEXT")
                if not self.word("ROW", "ROWS"):
                    self.expression()
                self.take("ROWS") or self.need("ROW")
                self.need("ONLY")
            else:
                self.take("FOR")
                self.take("UPDATE") or self.need("SHARE")

    def query_term(self) -> None:
        if self.accept("("):
            self.with_query()
            self.expect(")")
        elif self.take("VALUES"):
            self.listed(self.row)
        else:
            self.need("SELECT")
            if self.take("DISTINCT"):
                if self.take("ON"):
                    self.row()
            else:
                self.take("ALL")
            self.listed(self.select_item)
            if self.take("INTO"):
                self.name()
            if self.take("FROM"):
                self.listed(self.table)
            if self.take("WHERE"):
                self.expression()
            if self.take("GROUP", "BY"):
                self.listed(self.group_item)
            if self.take("HAVING"):
                self.expression()
            if self.take("WINDOW"):
                self.listed(self.named_window)
            if self.take("QUALIFY"):
                self.expression()

    def named_window(self) -> None:
        self.expect("id")
        self.need("AS")
        self.window()

    def group_item(self) -> None:
        if self.take("GROUPING") or self.take("ROLLUP") or self.take("CUBE"):
            self.take("SETS")
            self.expect("(")
            self.listed(self.group_item)
            self.expect(")")
        elif self.at("(") and self.ahead() == ")":
            self.i += 2
        else:
            self.expression()

    def row(self) -> None:
        self.expect("(")
        self.listed(self.value)
        self.expect(")")

    def value(self) -> None:
        self.take("DEFAULT") or self.expression()

    def select_item(self) -> None:
        if self.accept("*"):
            return
        self.expression()
        self.alias()

    def alias(self) -> None:
        if self.take("AS"):
            self.accept("str") or self.expect("id")
        else:
            self.accept("id")

    def order_item(self) -> None:
        self.expression()
        self.take("ASC") or self.take("DESC")
        if self.take("NULLS"):
            self.take("FIRST") or self.need("LAST")

    def table(self) -> None:
        self.table_primary()
        while True:
            if self.take("CROSS", "JOIN"):
                self.table_primary()
                continue
            natural = self.take("NATURAL")
            if self.take("LEFT") or self.take("RIGHT") or self.take("FULL"):
                self.take("OUTER") or self.take("SEMI") or self.take("ANTI")
                self.need("JOIN")
            elif self.take("INNER"):
                self.need("JOIN")
            elif not self.take("JOIN"):
                if natural:
                    self.fail("expected JOIN")
                return
            self.table_primary()
            if self.take("ON"):
                self.expression()
            elif self.take("USING"):
                self.names()

    def table_primary(self) -> None:
        self.take("LATERAL")
        if self.accept("("):
            if self.word("SELECT", "WITH", "VALUES") or self.at("("):
                self.with_query()
            else:
                self.table()
            self.expect(")")
        else:
            self.name()
            if self.at("("):
                self.arguments()
        if self.take("AS"):
            self.expect("id")
            if self.at("("):
                self.names()
        elif self.at("id") and not self.word("QUALIFY", "SEMI", "ANTI", "TABLESAMPLE"):
            self.skip()
            if self.at("("):
                self.names()
        if self.take("TABLESAMPLE"):
            if self.at("id"):
                self.name()
            self.expect("(")
            self.expression()
            self.take("PERCENT") or self.take("ROWS")
            self.expect(")")
            if self.take("REPEATABLE"):
                self.parenthesised()

    def insert(self) -> None:
        if self.take("OR"):
            self.skip()
        self.need("INTO")
        self.name()
        if self.take("AS"):
            self.expect("id")
        if self.at("(") and self.ahead() == "id":
            self.names()
        if not self.take("DEFAULT", "VALUES"):
            self.with_query()
        if self.take("ON"):
            self.need("CONFLICT")
            if self.at("("):
                self.row()
            if self.take("WHERE"):
                self.expression()
            self.need("DO")
            if not self.take("NOTHING"):
                self.need("UPDATE")
                self.assignments()
        self.returning()

    def returning(self) -> None:
        if self.take("RETURNING"):
            self.listed(self.select_item)

    def assignments(self) -> None:
        self.need("SET")
        self.listed(self.assignment)
        if self.take("FROM"):
            self.listed(self.table)
        if self.take("WHERE"):
            self.expression()

    def assignment(self) -> None:
        if self.at("("):
            self.names()
        else:
            self.name()
        self.expect("=")
        self.value()

    def update(self) -> None:
        self.name()
        if not self.at("SET"):
            self.alias()
        self.assignments()
        self.returning()

    def delete(self) -> None:
        self.need("FROM")
        self.name()
        if not self.at("WHERE"):
            self.alias()
        if self.take("USING"):
            self.listed(self.table)
        if self.take("WHERE"):
            self.expression()
        self.returning()

    def create(self) -> None:
        self.take("OR", "REPLACE")
        self.take("TEMPORARY") or self.take("TEMP") or self.take("UNLOGGED")
        if self.take("TABLE"):
            self.take("IF", "NOT", "EXISTS")
            self.name()
            if self.take("AS"):
                return self.with_query()
            self.expect("(")
            self.listed(self.table_element)
            self.expect(")")
            while self.take("WITHOUT", "ROWID") or self.take("STRICT"):
                self.accept(",")
            if self.take("AS"):
                self.with_query()
        elif self.word("VIEW", "MATERIALIZED", "RECURSIVE"):
            self.take("MATERIALIZED") or self.take("RECURSIVE")
            self.need("VIEW")
            self.take("IF", "NOT", "EXISTS")
            self.name()
            if self.at("("):
                self.names()
            self.need("AS")
            self.with_query()
        elif self.word("UNIQUE", "INDEX"):
            self.take("UNIQUE")
            self.need("INDEX")
            self.take("CONCURRENTLY")
            self.take("IF", "NOT", "EXISTS")
            if not self.at("ON"):
                self.name()
            self.need("ON")
            self.name()
            if self.take("USING"):
                self.expect("id")
            self.expect("(")
            self.listed(self.order_item)
            self.expect(")")
            if self.take("WHERE"):
                self.expression()
        elif self.take("FUNCTION") or self.take("PROCEDURE"):
            self.function()
        elif self.take("CONSTRAINT", "TRIGGER") or self.take("TRIGGER"):
            self.trigger()
        elif self.take("SEQUENCE"):
            self.take("IF", "NOT", "EXISTS")
            self.name()
            while not self.at("eof", ";"):
                if self.take("START") or self.take("INCREMENT"):
                    self.take("WITH") or self.take("BY")
                    self.accept("-")
                    self.expect("num")
                elif self.take("MINVALUE") or self.take("MAXVALUE") or self.take("CACHE"):
                    self.accept("-")
                    self.expect("num")
                elif self.take("OWNED", "BY"):
                    self.name()
                elif self.take("NO"):
                    self.take("MINVALUE") or self.take("MAXVALUE") or self.need("CYCLE")
                elif self.take("AS"):
                    self.type_name()
                else:
                    self.need("CYCLE")
        elif self.take("SCHEMA") or self.take("DATABASE") or self.take("EXTENSION"):
            self.take("IF", "NOT", "EXISTS")
            self.name()
        elif self.take("TYPE"):
            self.name()
            self.need("AS")
            if self.take("ENUM"):
                self.row()
            else:
                self.type_name()
        else:
            self.fail("kind of object expected")

    def table_element(self) -> None:
        if self.take("CONSTRAINT"):
            self.expect("id")
        if self.take("PRIMARY", "KEY") or self.take("UNIQUE"):
            return self.names()
        if self.take("FOREIGN", "KEY"):
            self.names()
            self.need("REFERENCES")
            return self.references()
        if self.take("CHECK"):
            return self.parenthesised()
        self.column()

    def column(self) -> None:
        self.expect("id")
        if self.at("id"):
            self.type_name()
        while True:
            if self.take("CONSTRAINT"):
                self.expect("id")
            if self.take("PRIMARY", "KEY"):
                self.take("ASC") or self.take("DESC")
                self.take("AUTOINCREMENT")
            elif self.take("NOT", "NULL") or self.take("NULL") or self.take("UNIQUE"):
                pass
            elif self.take("DEFAULT"):
                self.climb(5, self.operand, _LEVEL, rest=self.special)
            elif self.take("CHECK"):
                self.parenthesised()
            elif self.take("REFERENCES"):
                self.references()
            elif self.take("COLLATE"):
                self.name()
            elif self.take("GENERATED") or self.word("AS"):
                self.take("ALWAYS") or self.take("BY", "DEFAULT")
                self.need("AS")
                self.take("IDENTITY") or self.parenthesised()
                self.take("STORED") or self.take("VIRTUAL")
            else:
                return

    def references(self) -> None:
        self.name()
        if self.at("("):
            self.names()
        while self.take("ON"):
            self.take("DELETE") or self.need("UPDATE")
            if not (self.take("CASCADE") or self.take("RESTRICT") or self.take("NO", "ACTION")):
                self.need("SET")
                self.take("NULL") or self.need("DEFAULT")

    def type_name(self) -> None:
        self.name()
        self.take("PRECISION") or self.take("VARYING")
        if self.accept("("):
            self.listed(self.type_argument)
            self.expect(")")
        if self.take("WITH") or self.take("WITHOUT"):
            self.need("TIME", "ZONE")
        while self.accept("["):
            self.accept("num")
            self.expect("]")

    def type_argument(self) -> None:
        if self.accept("num") or self.accept("str"):
            return
        self.type_name()
        if self.at("id"):
            self.type_name()

    def alter(self) -> None:
        self.need("TABLE")
        self.take("IF", "EXISTS")
        self.name()
        self.listed(self.alteration)

    def alteration(self) -> None:
        if self.take("ADD"):
            self.take("COLUMN")
            self.take("IF", "NOT", "EXISTS")
            self.table_element()
        elif self.take("DROP"):
            self.take("COLUMN") or self.take("CONSTRAINT")
            self.take("IF", "EXISTS")
            self.expect("id")
            self.take("CASCADE")
        elif self.take("RENAME"):
            if not self.take("TO"):
                self.take("COLUMN")
                self.expect("id")
                self.need("TO")
            self.expect("id")
        elif self.take("ALTER"):
            self.take("COLUMN")
            self.expect("id")
            if self.take("TYPE") or self.take("SET", "DATA", "TYPE"):
                self.type_name()
            elif self.take("DROP"):
                self.take("DEFAULT") or self.need("NOT", "NULL")
            else:
                self.need("SET")
                if self.take("DEFAULT"):
                    self.expression()
                else:
                    self.need("NOT", "NULL")
        else:
            self.fail("alteration expected")

    def parenthesised(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def expression(self) -> None:
        self.climb(1, self.operand, _LEVEL, rest=self.special)

    def special(self, kind: str, level: int) -> bool:
        """Operators that are more than one word or take no plain right side."""
        if kind == "IS":
            self.skip()
            self.take("NOT")
            if self.take("DISTINCT"):
                self.need("FROM")
                self.climb(5, self.operand, _LEVEL, rest=self.special)
            elif not (self.take("NULL") or self.take("TRUE") or self.take("FALSE") or self.take("UNKNOWN")):
                self.climb(5, self.operand, _LEVEL, rest=self.special)
            return True
        if kind == "NOT":
            if self.ahead() not in ("IN", "LIKE", "ILIKE", "BETWEEN"):
                self.fail("operator expected after NOT")
            self.skip()
            kind = self.k[self.i]
        if kind == "IN":
            self.skip()
            self.expect("(")
            if self.word("SELECT", "WITH", "VALUES"):
                self.with_query()
            elif not self.at(")"):
                self.listed(self.expression)
            self.expect(")")
            return True
        if kind == "BETWEEN":
            self.skip()
            self.climb(5, self.operand, _LEVEL, rest=self.special)
            self.need("AND")
            self.climb(5, self.operand, _LEVEL, rest=self.special)
            return True
        if kind in ("LIKE", "ILIKE"):
            self.skip()
            self.climb(5, self.operand, _LEVEL, rest=self.special)
            if self.take("ESCAPE"):
                self.operand()
            return True
        if kind == "COLLATE":
            self.skip()
            self.name()
            return True
        if kind == "::":
            self.skip()
            self.type_name()
            return True
        return False

    def operand(self) -> None:
        kind = self.k[self.i]
        if kind in ("num", "param", "NULL", "DEFAULT"):
            self.skip()
        elif kind == "str":
            self.skip()
        elif kind in ("+", "-", "~"):
            self.skip()
            self.climb(9, self.operand, _LEVEL, rest=self.special)
        elif kind == "NOT":
            self.skip()
            self.climb(3, self.operand, _LEVEL, rest=self.special)
        elif kind == "(":
            self.skip()
            if self.word("SELECT", "WITH", "VALUES"):
                self.with_query()
            else:
                self.listed(self.expression)
            self.expect(")")
        elif kind == "EXISTS":
            self.skip()
            self.expect("(")
            self.with_query()
            self.expect(")")
        elif kind == "CASE":
            self.skip()
            if not self.at("WHEN"):
                self.expression()
            if not self.at("WHEN"):
                self.fail("expected WHEN")
            while self.take("WHEN"):
                self.expression()
                self.need("THEN")
                self.expression()
            if self.take("ELSE"):
                self.expression()
            self.need("END")
        elif kind == "CAST" or self.word("TRY_CAST"):
            self.skip()
            self.expect("(")
            self.expression()
            self.need("AS")
            self.type_name()
            self.expect(")")
        elif kind in ("ANY", "ALL", "SOME"):
            self.skip()
            self.expect("(")
            if self.word("SELECT", "WITH", "VALUES"):
                self.with_query()
            else:
                self.expression()
            self.expect(")")
        elif kind in ("LEFT", "RIGHT", "REPLACE", "SET") and self.ahead() == "(":
            self.skip()
            self.arguments()
        elif kind == "id":
            self.reference()
        else:
            self.fail("expression expected")
        while self.accept("["):
            if not self.at(":"):
                self.expression()
            if self.accept(":") and not self.at("]"):
                self.expression()
            self.expect("]")

    def reference(self) -> None:
        word = self.t[self.i].upper()
        if word in ("DATE", "TIME", "TIMESTAMP", "INTERVAL") and self.ahead() == "str":
            self.i += 2
            if word == "INTERVAL" and self.word("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"):
                self.skip()
            return
        if word in ("ARRAY", "ROW") and self.ahead() in ("[", "("):
            self.skip()
            close = "]" if self.skip() == "[" else ")"
            if not self.at(close):
                self.listed(self.expression)
            self.expect(close)
            return
        if word == "EXTRACT" and self.ahead() == "(":
            self.i += 2
            self.skip()
            self.need("FROM")
            self.expression()
            self.expect(")")
            return
        self.skip()
        while self.accept("."):
            if self.accept("*"):
                return
            self.expect("id")
        if self.at("("):
            self.arguments()
            if self.take("FILTER"):
                self.expect("(")
                self.need("WHERE")
                self.expression()
                self.expect(")")
            if self.take("WITHIN", "GROUP"):
                self.expect("(")
                self.need("ORDER", "BY")
                self.listed(self.order_item)
                self.expect(")")
            if self.take("OVER"):
                if not self.accept("id"):
                    self.window()

    def arguments(self) -> None:
        self.expect("(")
        if self.accept(")"):
            return
        if self.accept("*"):
            self.expect(")")
            return
        self.take("DISTINCT") or self.take("ALL")
        self.listed(self.argument)
        if self.take("FROM") or self.take("FOR"):
            self.expression()
            if self.take("FOR"):
                self.expression()
        if self.take("ORDER", "BY"):
            self.listed(self.order_item)
        self.expect(")")

    def argument(self) -> None:
        if self.word("SELECT", "WITH"):
            self.with_query()
        else:
            self.expression()

    def window(self) -> None:
        self.expect("(")
        if self.at("id") and not self.word("PARTITION", "ROWS", "RANGE", "GROUPS"):
            self.skip()
        if self.take("PARTITION"):
            self.need("BY")
            self.listed(self.expression)
        if self.take("ORDER", "BY"):
            self.listed(self.order_item)
        if self.take("ROWS") or self.take("RANGE") or self.take("GROUPS"):
            if self.take("BETWEEN"):
                self.bound()
                self.need("AND")
            self.bound()
        self.expect(")")

    def bound(self) -> None:
        if self.take("CURRENT"):
            self.need("ROW")
            return
        if not self.take("UNBOUNDED"):
            self.climb(5, self.operand, _LEVEL, rest=self.special)
        self.take("PRECEDING") or self.need("FOLLOWING")


def check(source: str) -> list[SyntaxIssue]:
    p = Sql(source)
    p.script()
    return p.issues

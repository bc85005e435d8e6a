"""The SQL front: UNNEST, parameters, labels, session settings, tables declared with a JSON plugin, timings."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

from ..functions.scalars import register_aggregate, register_scalar, register_table
from ..sources import catalog

#: A token: white space, a comment, a string, a quoted name, a word or number, or a sign.
_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|[\w$]+(?:\.\d+)?|.", re.S)
_LABEL = re.compile(r"/\*\+\s*QUERY_INFO\s*\(\s*name\s*=\s*'([^']*)'\s*\)\s*\*/", re.I)
_SET = re.compile(r"\s*(?:alter\s+(?:session|system)\s+)?set\s+(computeunits|hwmode|cpudop|gpudop|timings)\s*=\s*(?:'([^']*)'|(\w+))\s*;?\s*$", re.I)
#: Words that end a FROM item, so they can't be its alias.
_ENDS = {"where", "group", "order", "having", "limit", "offset", "join", "inner", "left", "right", "full", "cross", "natural", "on", "using", "union", "intersect", "except", "window", "lateral", "tablesample"}
#: Words that begin a table's constraint instead of a column.
_CONSTRAINTS = {"primary", "foreign", "unique", "check", "constraint", "key"}
TIMINGS = "total_time long, planning_time long, plan2json_time long, executor_time long, codegen_time long, dataload_time long, code_opt_time long, code_optnload_time long, execution_time long, timestamp string, query string, cmd_type string, hwmode string, plan string, query_name string"


def tokens(sql: str) -> list[str]:
    return _TOKEN.findall(sql)


def _blank(token: str) -> bool:
    return token.isspace() or token.startswith(("--", "/*"))


def _next(parts: list[str], i: int) -> int:
    """The next token from i on that says something, or the end."""
    while i < len(parts) and _blank(parts[i]):
        i += 1
    return i


def _closing(parts: list[str], i: int) -> int:
    """The position of the bracket that closes the one at i."""
    depth = 0
    for k in range(i, len(parts)):
        depth += (parts[k] == "(") - (parts[k] == ")")
        if depth == 0:
            return k
    raise ValueError("a bracket isn't closed")


def unnests(sql: str) -> int:
    """How many UNNEST items with one column the text has: those whose element may be a record or a value."""
    return rewrite(sql, ())[1]


def rewrite(sql: str, records: tuple[bool, ...] = ()) -> tuple[str, int]:
    """UNNEST in a FROM clause becomes a lateral table function; strings, comments and names in quotes stay.

    FROM t, UNNEST(t.c) AS e gives e, the element; with columns, e(a, b), its fields by position, and with one
    column the field or the value itself: records says which, for each such item in turn (unsaid: a record).
    Returns the text and the number of items with one column.
    """
    parts, out, i, single = tokens(sql), [], 0, 0
    while i < len(parts):
        if parts[i].lower() != "unnest":
            out.append(parts[i])
            i += 1
            continue
        open_ = _next(parts, i + 1)
        if open_ >= len(parts) or parts[open_] != "(":
            out.append(parts[i])
            i += 1
            continue
        close = _closing(parts, open_)
        path = "".join(parts[open_ + 1 : close]).strip()
        at = _next(parts, close + 1)
        if at < len(parts) and parts[at].lower() == "as":
            at = _next(parts, at + 1)
        alias, end, columns = "element", close + 1, None
        if at < len(parts) and re.match(r"[\w`\"]", parts[at]) and parts[at].lower() not in _ENDS:
            alias, end = parts[at], at + 1
            bracket = _next(parts, end)
            if bracket < len(parts) and parts[bracket] == "(":
                last = _closing(parts, bracket)
                columns, end = "".join(parts[bracket + 1 : last]), last + 1
        one = columns is not None and "," not in columns
        record = columns is not None and (not one or single >= len(records) or records[single])
        single += one
        before = next((x.lower() for x in reversed(out) if not _blank(x)), "")
        out.append(f"{'' if before == 'lateral' else 'LATERAL '}{'inline' if record else 'explode'}({path}) AS {alias}({columns or alias})")
        i = end
    return "".join(out), single


def _columns(parts: list[str]) -> list[list[str]]:
    """What stands between commas that no bracket holds."""
    out, depth = [[]], 0
    for p in parts:
        depth += (p == "(") - (p == ")")
        if p == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(p)
    return [x for x in out if any(not _blank(p) for p in x)]


class SqlFront:
    """Runs SQL texts; a QUERY_INFO hint becomes the job's description. Timings of what was run are a table, SessionTimings.

    Names are matched without case unless case_sensitive. Clients of other languages connect to a session through
    Spark Connect or the Thrift server, which speak for themselves.
    """

    def __init__(self, spark: SparkSession, case_sensitive: bool = False):
        self.spark, self.case_sensitive = spark, case_sensitive
        self.prepared: dict[str, str] = {}
        self.settings: dict[str, str] = {"timings": "on", "hwmode": "cpuonly"}
        self.catalog = catalog.Catalog(spark, {})
        self._rows: list[tuple] = []

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        label = _LABEL.search(text)
        body = _LABEL.sub("", text).strip().rstrip(";")
        self.spark.sparkContext.setJobDescription(label[1] if label else None)
        began = time.time()
        df = self._statement(body, args)
        self._note(label[1] if label else "", body, began, time.time() - began, None)
        return df

    def run(self, text: str, args: dict | list | None = None) -> list[Row]:
        """The rows of a text's result, whose execution is timed, too."""
        df = self.sql(text, args)
        began = time.time()
        rows = df.collect()
        if self._rows:
            last = self._rows.pop()
            took = int(1000 * (time.time() - began))
            self._rows.append((last[0] + took, *last[1:8], took, *last[9:]))
        return rows

    def _statement(self, text: str, args: dict | list | None) -> DataFrame:
        done = self.spark.createDataFrame([], "result string")
        setting = _SET.match(text)
        if setting:
            self._set(setting[1].lower(), setting[2] or setting[3])
            return done
        parts = [p for p in tokens(text) if not _blank(p)]
        if [p.lower() for p in parts[:2]] == ["create", "table"] and any(p.lower() == "jplugin" for p in parts):
            self._declare(text)
            return done
        if any(p.lower() in ("sessiontimings", "`sessiontimings`") for p in parts):
            self.session_timings().createOrReplaceTempView("SessionTimings")
        return self._select(text, args)

    def _select(self, text: str, args: dict | list | None) -> DataFrame:
        key = "spark.sql.caseSensitive"
        was = self.spark.conf.get(key)
        failed = None
        self.spark.conf.set(key, str(self.case_sensitive).lower())
        try:
            # Whether the one column of an item is a record's field or the value itself follows from the type.
            for records in product((True, False), repeat=unnests(text)):
                try:
                    query = rewrite(text, records)[0]
                    return self.spark.sql(query, args=args) if args else self.spark.sql(query)
                except AnalysisException as e:
                    failed = failed or e
                    if "inline" not in str(e):
                        break
            raise failed
        finally:
            self.spark.conf.set(key, was)

    def _set(self, name: str, value: str) -> None:
        """cpudop is the number of partitions that shuffles make; what names other devices is kept as information."""
        self.settings[name] = value
        if name == "cpudop":
            self.spark.conf.set("spark.sql.shuffle.partitions", str(int(value)))

    def _declare(self, text: str) -> None:
        """CREATE TABLE [IF NOT EXISTS] name (column type [NOT NULL] [AS (expression)], constraint, ...) JPLUGIN 'json'."""
        parts = tokens(text)
        open_ = parts.index("(")
        close = _closing(parts, open_)
        words = [p for p in parts[:open_] if not _blank(p)]
        name = words[-1].strip("`\"")
        if len(words) > 3 and name in self.catalog.entries:
            return
        said = next(p for p in parts[close + 1 :] if p.startswith("'"))
        plugin = json.loads(said[1:-1].replace("''", "'"))
        fields, made, constraints = [], [], []
        for column in _columns(parts[open_ + 1 : close]):
            own = [p for p in column if not _blank(p)]
            if own[0].lower() in _CONSTRAINTS:
                constraints.append(" ".join(own))
                continue
            lower = [p.lower() for p in own]
            if "as" in lower:  # generated: worked out when it is read
                at = lower.index("as")
                made.append(f"cast({''.join(column[column.index(own[at]) + 1 :]).strip()} as {own[1]}) as {own[0]}")
                continue
            if "not" in lower and "null" in lower:
                constraints.append(f"{own[0]} not null")
                own = own[: lower.index("not")]
            fields.append(f"{own[0]} {''.join(own[1:])}")
        spec = plugin.get("plugin") or {"type": "block"}
        self.catalog.entries[name] = {"path": plugin["file"], "plugin": spec, "constraints": constraints}
        columns = catalog.ddl_schema(", ".join(fields))
        df = catalog.read(self.spark, plugin["file"], spec["type"], columns, **self.catalog.options(spec))
        df.selectExpr("*", *made).createOrReplaceTempView(name)

    def prepare(self, text: str) -> str:
        """Keeps a text with parameters (? or :name) under a new label."""
        label = f"stmt{len(self.prepared)}"
        self.prepared[label] = text
        return label

    def execute(self, label: str, args: dict | list | None = None) -> DataFrame:
        return self.sql(self.prepared[label], args)

    def explain(self, text: str) -> str:
        return self.sql(text)._jdf.queryExecution().toString()

    def function(self, name: str, f: Callable, returns: str) -> None:
        """A scalar function for SQL texts: f takes and returns pandas Series."""
        register_scalar(self.spark, name, f, returns)

    def aggregate(self, name: str, f: Callable, returns: str) -> None:
        """An aggregate for SQL texts: f takes pandas Series of a group and returns one value."""
        register_aggregate(self.spark, name, f, returns)

    def table_function(self, name: str, handler: type, returns: str) -> None:
        """A table function for SQL texts: handler has eval(*args), which yields rows."""
        register_table(self.spark, name, handler, returns)

    def _note(self, label: str, text: str, began: float, took: float, execution: int | None) -> None:
        if self.settings["timings"].lower() in ("off", "false"):
            return
        kind = next((p.lower() for p in tokens(text) if not _blank(p)), "")
        stamp = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(began))
        planning = int(1000 * took)
        self._rows.append((planning, planning, None, None, None, None, None, None, execution, stamp, text, kind, self.settings["hwmode"], None, label))

    def session_timings(self) -> DataFrame:
        """A row for each text, times in milliseconds. Planning covers parsing and analysis; execution is known for texts that run() has run; what the engine doesn't tell apart is null."""
        return self.spark.createDataFrame(self._rows, TIMINGS)

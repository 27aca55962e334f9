"""Read-only SQL over named frames.

Spark parses and resolves the statement; what decides is the resolved plan.  It may read the given
frames, inline values, `range` and common table expressions, and nothing else, whatever way a
relation was named.
"""

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

_FIRST_WORD = re.compile(r"(?:\s|--[^\n]*\n|/\*.*?\*/|\()*(\w+)", re.S)
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: Nodes without children that read nothing that is stored.
_FREE = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "EmptyRelation", "UnionLoopRef"}
_REFUSED_NODES = {"ScriptTransformation": "script transforms"}
_REFUSED_EXPRESSIONS = {"CallMethodViaReflection"}


def _each(seq):
    return [seq.apply(i) for i in range(seq.length())]


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _is(spark: SparkSession, node, kind: str) -> bool:
    return spark._jvm.java.lang.Class.forName(_LOGICAL + kind).isInstance(node)


def _parsed(spark: SparkSession, sql: str, names) -> None:
    """Raise PermissionError unless `sql` is one query; Spark would run a command at once.

    Relations that are named in plain words are refused here, before anything is looked up.
    """
    word = _FIRST_WORD.match(sql)
    if word is None or word.group(1).upper() not in ("SELECT", "WITH"):
        raise PermissionError("only one SELECT statement is allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise PermissionError("only one SELECT statement is allowed") from e
    named, own, todo = [], {n.lower() for n in names}, [plan]
    while todo:
        node = todo.pop()
        if _is(spark, node, "Command") or _is(spark, node, "ParsedStatement"):
            raise PermissionError("inserts and commands are not allowed")
        if _name(node) in _REFUSED_NODES:
            raise PermissionError(f"{_REFUSED_NODES[_name(node)]} are not allowed")
        if _name(node) == "UnresolvedRelation":
            named.append(_each(node.multipartIdentifier()))
        if _name(node) == "UnresolvedWith":
            for relation in _each(node.cteRelations()):
                own.add(relation._1().lower())
                todo.append(relation._2())
        _check_expressions(node)
        todo += _each(node.children()) + _each(node.subqueries())
    unknown = sorted(".".join(n) for n in named if len(n) > 1 or n[0].lower() not in own)
    if unknown:
        raise PermissionError(f"not among the given frames: {unknown}")


def _check_expressions(node) -> None:
    todo = _each(node.expressions())
    while todo:
        e = todo.pop()
        called = _name(e) == "UnresolvedFunction" and _each(e.nameParts())[-1].lower()
        if _name(e) in _REFUSED_EXPRESSIONS or called in ("reflect", "try_reflect", "java_method"):
            raise PermissionError("calls of the JVM are not allowed")
        todo += _each(e.children())


def check_plan(plan, names) -> None:
    """Raise PermissionError if a resolved plan reads anything but the views of `names`."""
    names = {n.lower() for n in names}
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = _name(node)
        if kind == "View" and node.isTempView() and node.desc().identifier().table().lower() in names:
            continue  # what a given frame reads is not the statement's doing
        if kind in _REFUSED_NODES:
            raise PermissionError(f"{_REFUSED_NODES[kind]} are not allowed")
        _check_expressions(node)
        below = _each(node.children()) + _each(node.subqueries())
        if kind == "View" or (not below and kind not in _FREE):
            raise PermissionError(f"not among the given frames: {node.simpleString(100)}")
        todo += below


def query(spark: SparkSession, sql: str, frames: dict[str, DataFrame],
          params: dict | None = None) -> DataFrame:
    """Run one SELECT (or WITH ... SELECT) over frames, with bound parameters.

    Anything else is refused: commands, inserts, script transforms, calls of the JVM, and relations
    that are not given (files, catalog tables, other views).  Values are bound and never pasted into
    the text.  The frames' names are views only while the statement is resolved.
    """
    sql = sql.rstrip().rstrip(";")
    _parsed(spark, sql, frames)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    try:
        found = spark.sql(sql, args=params or {})
        check_plan(found._jdf.queryExecution().analyzed(), frames)
        return found
    finally:
        for name in frames:
            spark.catalog.dropTempView(name)

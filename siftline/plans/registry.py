"""Named queries and the SQL each is checked against."""
import re

from ..views import VIEW_SQL

QUERIES = {}
CHECK_SQL = {}


def query(name: str, sql: str | None = None):
    """Register a ``(spark, folder) -> DataFrame`` under a name, with its check if SQL can say it."""

    def add(build):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            CHECK_SQL[name] = with_views(sql)
        return build

    return add


def with_views(sql: str) -> str:
    """Prefix the definitions of every derived view the text mentions."""
    needed, queue = [], [sql]
    while queue:
        text = queue.pop()
        for view in VIEW_SQL:
            if re.search(rf"\b{view}\b", text) and view not in needed:
                needed.append(view)
                queue.append(VIEW_SQL[view])
    parts = [f"{view} AS ({VIEW_SQL[view]})" for view in VIEW_SQL if view in needed]
    body = sql.strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        recursive = body[5:].lstrip().upper().startswith("RECURSIVE ")
        rest = body[5:].lstrip()[10:] if recursive else body[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + ",\n" + rest
    return "WITH " + ",\n".join(parts) + "\n" + body


def sql_list(words) -> str:
    return ", ".join("'" + str(w).replace("'", "''") + "'" for w in words)


def sql_text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def sql_values(name: str, columns: list, rows: list) -> str:
    """``name(columns) AS (VALUES ...)`` for a WITH clause."""
    body = ", ".join("(" + ", ".join(sql_text(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def sql_any(column: str, words) -> str:
    """Substring test for any of the words."""
    return "(" + " OR ".join(f"contains({column}, {sql_text(w)})" for w in words) + ")"


SQL_BLANK = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"


def sql_count(column: str, word: str) -> str:
    return f"((length({column}) - length(replace({column}, {sql_text(word)}, ''))) // {len(word)})"

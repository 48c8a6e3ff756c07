"""Program texts: what they are written in, and their units. The parsers are Python's own; each row is read alone, in Arrow batches."""

import ast
import json
import re

import pandas as pd
from pyspark.sql import DataFrame

# Words that SQL statements begin with, and the sizes of a unit.
SQL_STARTS = ["select", "insert", "update", "delete", "create", "drop", "alter", "with", "pragma"]
LEAST, MOST, WHOLE = 30, 3000, 4000


def _language(text) -> str:
    if not text or not text.strip():
        return "unknown"
    try:
        ast.parse(text)
        return "python"
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    if text.strip()[0] in "{[":
        try:
            json.loads(text)
            return "json"
        except (ValueError, RecursionError):
            pass
    if re.match(rf"\s*({'|'.join(SQL_STARTS)})\b", text, re.I):
        return "sql"
    return "bash" if re.match(r"\s*(#!.*sh\b|(sudo|cd|echo|export|ls|grep|curl|mkdir|if \[)\b)", text) else "unknown"


def languages(rows: DataFrame) -> DataFrame:
    """id, language of rows(id, text): python if it parses, else json if it does, else sql or bash by how it begins (no shell or database is asked); unknown for null, empty and other texts."""
    def each(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "language": [_language(t) for t in b["text"]]})

    return rows.select("id", "text").mapInPandas(each, f"id {dict(rows.dtypes)['id']}, language string")


def _units(text):
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [("module", "module", text)] if len(text) < WHOLE else []
    lines, out = (text or "").splitlines(), []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            code = "\n".join(lines[node.lineno - 1 : node.end_lineno])
            if LEAST <= len(code) <= MOST:
                out.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, code))
    return out


def units(rows: DataFrame) -> DataFrame:
    """id, kind, name, code of the functions and classes of 30 to 3,000 characters in rows(id, text); a text under 4,000 characters that doesn't parse is one unit, a module. Null and empty texts have none."""
    def each(batches):
        for b in batches:
            found = [(i, *u) for i, t in zip(b["id"].tolist(), b["text"]) if t for u in _units(t)]
            yield pd.DataFrame(found, columns=["id", "kind", "name", "code"])

    return rows.select("id", "text").mapInPandas(each, f"id {dict(rows.dtypes)['id']}, kind string, name string, code string")

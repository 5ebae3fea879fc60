"""Splitting a script into statements, and rewriting statements for Spark SQL. Runs on the driver: a script is one file."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""--[^\n]*                         # a comment to the end of the line
      | /\*.*?(?:\*/|\Z)                # a comment block
      | '(?:[^']|'')*(?:'|\Z)           # a string
      | "(?:[^"]|"")*(?:"|\Z)           # a quoted name
      | (\$[A-Za-z_]*\$).*?(?:\1|\Z)    # a dollar-quoted string
      | ;
      | [^-/'"$;]+ | .""",
    re.S | re.X,
)


def split_statements(script: str, compat: bool = False) -> list[str]:
    """Statements in order.

    compat: split at every semicolon and leave out chunks that begin with a comment. Otherwise comments are taken out first, and
    semicolons in strings, quoted names and dollar quotes don't split.
    """
    if compat:
        chunks = [c.strip() for c in script.split(";")]
        return [c for c in chunks if c and not c.startswith("--")]
    out, now = [], []
    for m in _TOKEN.finditer(script):
        t = m[0]
        if t == ";":
            out.append("".join(now))
            now = []
        elif t.startswith(("--", "/*")):
            now.append(" ")
        else:
            now.append(t)
    out.append("".join(now))
    return [s.strip() for s in out if s.strip()]


#: Types that Spark SQL has under another name, where a type may stand.
_TYPES = [
    (r"TIMESTAMP(?:\s*\(\d+\))?\s+WITH\s+TIME\s+ZONE|TIMESTAMPTZ(?:\s*\(\d+\))?", "TIMESTAMP"),
    (r"TIMESTAMP(?:\s*\(\d+\))?\s+WITHOUT\s+TIME\s+ZONE", "TIMESTAMP_NTZ"),
    (r"BIGSERIAL|SERIAL8", "BIGINT"),
    (r"SMALLSERIAL", "SMALLINT"),
    (r"SERIAL4?", "INT"),
    (r"UUID|TEXT|JSONB?|CITEXT|INET|TIME(?:\s+WITH(?:OUT)?\s+TIME\s+ZONE)?", "STRING"),
    (r"BYTEA", "BINARY"),
    (r"DOUBLE\s+PRECISION|FLOAT8", "DOUBLE"),
    (r"REAL|FLOAT4", "FLOAT"),
    (r"CHARACTER\s+VARYING(?=\s*\()", "VARCHAR"),
    (r"(?:CHARACTER\s+VARYING|VARCHAR)(?!\s*\()", "STRING"),
    (r"NUMERIC(?!\s*\()", "DECIMAL(38, 18)"),
]
_TYPES = [(re.compile(rf"(?:{p})(?![\w])", re.I), other) for p, other in _TYPES]
#: What may follow a column's type and has nothing to do here.
_CLAUSES = [
    (r"\bDEFAULT\s+(?:gen_random_uuid|uuid_generate_v4)\s*\(\s*\)", ""),
    (r"\bDEFAULT\s+(?:NOW\s*\(\s*\)|CURRENT_TIMESTAMP\b(?!\s*\())", "DEFAULT current_timestamp()"),
    (r"\bPRIMARY\s+KEY\b", ""),
    (r"\bUNIQUE\b", ""),
    (r"\bREFERENCES\s+(?:\"[^\"]+\"|[\w.])+\s*(?:\([^)]*\))?(?:\s+ON\s+(?:DELETE|UPDATE)\s+(?:CASCADE|RESTRICT|NO\s+ACTION|SET\s+NULL|SET\s+DEFAULT))*", ""),
]
_CLAUSES = [(re.compile(p, re.I), other) for p, other in _CLAUSES]
_KEYS = re.compile(r"(?:CONSTRAINT\s+(?:\"[^\"]+\"|\w+)\s+)?(?:PRIMARY\s+KEY|UNIQUE|FOREIGN\s+KEY)\s*\(", re.I)
_NAME = r"(?:\"(?:[^\"]|\"\")+\"|`[^`]+`|[\w$]+)"
_CREATE = re.compile(rf"(CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}(?:\s*\.\s*{_NAME})*\s*)\(", re.I)
_ADD = re.compile(r"\bADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?(?!CONSTRAINT\b|COLUMNS\b|PARTITION\b)", re.I)
_NOTHING = re.compile(r"(?:CREATE\s+(?:UNIQUE\s+)?INDEX|DROP\s+INDEX|GRANT|REVOKE|BEGIN|COMMIT|ROLLBACK|CREATE\s+EXTENSION|COMMENT\s+ON)\b", re.I)


def _outside_strings(statement: str, change) -> str:
    return "".join(p if k % 2 else change(p) for k, p in enumerate(re.split(r"('(?:[^']|'')*')", statement)))


def _without_comments(statement: str) -> str:
    return "".join(" " if m[0].startswith(("--", "/*")) else m[0] for m in _TOKEN.finditer(statement)).strip()


def _list_end(text: str, at: int) -> tuple[list[str], int]:
    """The parts of a list in parentheses, cut at its own commas, and where it ends; `at` is just after it opens."""
    depth, parts, now = 1, [], []
    for m in re.finditer(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|.", text[at:], re.S):
        c = m[0]
        depth += (c == "(") - (c == ")")
        if not depth:
            return [*parts, "".join(now)], at + m.end()
        if c == "," and depth == 1:
            parts.append("".join(now))
            now = []
        else:
            now.append(c)
    return [*parts, "".join(now)], len(text)


def _type(text: str) -> str:
    """A text that begins with a type."""
    for pattern, other in _TYPES:
        if m := pattern.match(text):
            text = other + text[m.end() :]
            break
    return re.sub(r"\A(\w+(?:\s*\([^)]*\))?)\s*((?:\[\d*\])+)", lambda m: "ARRAY<" * m[2].count("[") + m[1] + ">" * m[2].count("["), text)


def _column(text: str) -> str:
    """`name type clauses`: the name stays as it is, whatever it is."""
    m = re.match(rf"({_NAME})(\s+)(.*)\Z", text.strip(), re.S)
    if not m:
        return text

    def clauses(part: str) -> str:
        for pattern, other in _CLAUSES:
            part = pattern.sub(other, part)
        return part

    return f"{m[1]} {_outside_strings(_type(m[3]), lambda p: re.sub(r'\s+', ' ', clauses(p))).strip()}"


def rewritten(statement: str) -> str | None:
    """A PostgreSQL statement for Spark SQL; None if it does nothing here (indexes, grants, transactions).

    Types are rewritten only where a type may stand: after a column's name. Names stay, quoted or not; so do strings.
    """
    s = _without_comments(statement)
    if not s or _NOTHING.match(s):
        return None
    if m := _CREATE.match(s):
        parts, end = _list_end(s, m.end())
        columns = [_column(p) for p in parts if not _KEYS.match(p.strip())]
        rest = s[end:]
        s = f"{m[1]}({', '.join(c.strip() for c in columns)}){rest}" + ("" if re.search(r"\bUSING\b", rest, re.I) else " USING parquet")
    elif re.match(r"ALTER\s+TABLE\b", s, re.I):
        if m := _ADD.search(s):
            s = f"{s[: m.start()]}ADD COLUMN {_column(s[m.end() :])}"
        else:
            s = re.sub(r"(\bALTER\s+COLUMN\s+\S+\s+)(?:SET\s+DATA\s+)?TYPE\s+(.*)\Z", lambda m: f"{m[1]}TYPE {_type(m[2])}", s, flags=re.I | re.S)
    if re.match(r"DROP\s+TABLE\b", s, re.I):
        s = re.sub(r"\s+(?:CASCADE|RESTRICT)\s*\Z", "", s, flags=re.I)
    if re.match(r"CREATE\s+DATABASE\b", s, re.I):
        s = re.sub(r"\s+(?:WITH\s+)?OWNER\s*=?\s*\S+", "", s, flags=re.I)
    s = _outside_strings(s, lambda p: re.sub(r"\bNOW\s*\(\s*\)", "current_timestamp()", re.sub(r"\bgen_random_uuid\s*\(\s*\)", "uuid()", p, flags=re.I), flags=re.I))
    return _outside_strings(s, lambda p: re.sub(r'"((?:[^"]|"")+)"', lambda m: "`" + m[1].replace('""', '"').replace("`", "``") + "`", p))

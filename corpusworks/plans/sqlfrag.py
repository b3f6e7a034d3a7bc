"""Shared DuckDB SQL fragments for the oracle twins."""

# Python's str.isspace() characters as a DuckDB string expression (for trim)
SQL_STRIP_CHARS = ("chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)"
                   "||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)"
                   "||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)"
                   "||chr(8287)||chr(12288)")


def sql_strip(x: str) -> str:
    return f"trim({x}, {SQL_STRIP_CHARS})"


def sql_str(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) if s else "''"

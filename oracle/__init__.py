"""Independent DuckDB statements for the registered queries."""

from oracle.tables import TABLES, statement
from oracle.statements import STATEMENTS


def all_statements() -> dict[str, str]:
    return {name: statement(body) for name, body in STATEMENTS.items()}


__all__ = ["STATEMENTS", "TABLES", "all_statements", "statement"]

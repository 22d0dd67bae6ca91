"""All queries of the engine and, where SQL can express them, their DuckDB SQL."""

from grantloom.plans import decisions, feeds, fields, publishing, searching, upkeep

MODULES = [fields, searching, decisions, upkeep, publishing, feeds]
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL: dict = {k: v for m in MODULES for k, v in m.SQL.items()}

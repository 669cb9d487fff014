"""Named queries over the given tables, each with the SQL that must give the same rows."""

from cellquery.catalog import evaluation, matching, pages, prompts, questions, storage, tables, text

MODULES = [pages, text, tables, matching, questions, prompts, evaluation, storage]


def queries() -> dict:
    """Name to ``(spark, folder) -> DataFrame``."""
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to SQL, for the queries that have one."""
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}

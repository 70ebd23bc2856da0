"""Where queries and their SQL are registered."""

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) with the SQL that gives the same rows."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add

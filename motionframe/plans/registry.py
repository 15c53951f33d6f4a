"""Registry of queries: name -> (builder over Tables, SQL twin or None)."""

from motionframe.sources.binding import Tables

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a builder ``f(tables) -> DataFrame`` and its SQL twin."""

    def wrap(build):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap

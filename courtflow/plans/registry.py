"""Named queries: each reads the given tables and has, where SQL can say it, an oracle."""

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    """Register ``fn(inputs) -> DataFrame``; ``oracle`` is the same question in SQL."""

    def register(fn):
        def run(spark, sf_dir):
            from .inputs import Inputs

            return fn(Inputs(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        run.__wrapped_module__ = fn.__module__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def r(expr, places):
    """SQL twin of ``geometry.rounded``."""
    s = f"{10**places}e0"
    return f"(floor(({expr})*{s}+0.5e0)/{s})"

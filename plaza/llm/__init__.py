"""Operators for training-data pipelines; see ``registry`` for their queries.

The registry is imported when it is asked for, so a worker process loads the
modules of its own operator only.
"""


def queries():
    from plaza.llm import registry

    return registry.queries()


def oracle_sql():
    from plaza.llm import registry

    return registry.oracle_sql()

"""Operations for training-data pipelines.

Nothing else in the library imports this subpackage; ``queries()`` and
``oracle_sql()`` are picked up by ``__spark_entry__.py`` when it is present.
"""

from factloom.llm.entry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

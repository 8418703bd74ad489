"""DuckDB oracle SQL for every registered query (the correctness gate).

``adapter.with_ctes()`` is the DuckDB text of the driver-table -> star adapter;
``queries.ORACLE`` maps query keys to SQL bodies that read those CTEs.
"""

import sqloracle.chain  # noqa: F401  (registers its queries and those of matching)
from sqloracle.queries import oracle_sql  # noqa: F401

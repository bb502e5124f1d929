"""Independent DuckDB SQL for every registered report.

Written from the report definitions in plain SQL and sharing no code with
the Spark side.  Money is carried as integer cents, miles as thousandths,
durations as seconds; every rounded output is an integer division rounded
half away from zero, then scaled to DOUBLE, so values compare exactly.
"""

from oracle.queries import ORACLE_SQL  # noqa: F401

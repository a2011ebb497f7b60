"""All core queries and their SQL."""

from pairloom.plans import matching, matching_sql, prepare

QUERIES = {**matching.QUERIES, **prepare.QUERIES}
ORACLE = {**matching_sql.ORACLE, **prepare.ORACLE}

"""All registered queries and the SQL that checks them."""

from agoralytics.catalog import featured, lexicons, modelled, private, relational, summaries, texts

_FAMILIES = (relational, texts, summaries, lexicons, private, featured, modelled)

QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}

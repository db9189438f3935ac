"""The registered queries: operators applied to the given tables, each with the SQL that gives the same rows."""

"""The registered queries, each with the SQL that it must agree with."""

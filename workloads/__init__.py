"""Registered queries: each operator over whole tables, with the SQL it must equal."""

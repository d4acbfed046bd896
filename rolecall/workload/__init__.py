"""The engine's operators bound to the test tables, with an SQL statement for each result."""

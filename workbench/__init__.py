"""The operators over the test tables: roles, registered queries and their check SQL."""

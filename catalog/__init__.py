"""The registered queries: the given tables in dataset roles, with SQL for each."""

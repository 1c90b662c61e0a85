"""The registered queries over the reference operators, each with the SQL that states its result."""

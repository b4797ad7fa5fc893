"""triloom: graph-pattern queries over triples and tables, compiled to DataFrame plans."""

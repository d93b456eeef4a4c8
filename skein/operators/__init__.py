"""DataFrame operators over nodes, edges, ledgers, names and passages."""

"""Column expressions on band arrays; none of them leaves its row."""

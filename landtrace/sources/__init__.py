"""Reading and writing of tables, tile listings and observations."""

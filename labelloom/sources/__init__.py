"""Reading tables, writing results."""

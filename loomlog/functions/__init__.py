"""Column expressions; nothing here runs Python per row."""

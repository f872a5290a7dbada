"""Column functions: text, titles, times, numbers."""

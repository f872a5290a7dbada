"""Registered queries over the driver's tables, each with equivalent SQL where SQL can express it."""

"""Event-schedule analytics on PySpark: sources, entity resolution, serving queries and stateful jobs."""

"""The snapshot and ledger operators as Structured Streaming sinks."""

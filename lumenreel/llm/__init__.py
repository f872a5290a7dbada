"""Training-data operators: ten large-scale jobs over documents and embeddings.

Each module holds one operator with its own general interface and the thin
``opN_`` query that applies it; ``registry`` gathers queries and their SQL.
Nothing outside this subpackage imports it.
"""

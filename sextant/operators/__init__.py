"""DataFrame operators: ranked retrieval, graph traversal, ingest, monitoring."""

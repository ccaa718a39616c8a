"""Report datasets and the registered queries, composed from the operators."""

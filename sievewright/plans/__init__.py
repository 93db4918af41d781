"""Search trees, their compilation to Catalyst expressions, and the graph of models."""

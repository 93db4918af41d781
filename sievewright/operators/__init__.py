"""Reading and changing entities: searches, eager loading, bulk mutations, links."""

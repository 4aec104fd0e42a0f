"""Named queries over the base tables and their SQL counterparts."""

"""The reference has no streaming operator. Its functions are Column expressions, so they apply to
a streaming DataFrame as they stand; nothing stateful is needed."""

"""Gap logic that also runs on streams."""

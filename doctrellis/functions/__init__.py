"""Column expressions: text, Markdown and small value helpers (all JVM-side)."""

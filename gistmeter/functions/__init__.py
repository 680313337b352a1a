"""Column expressions and Arrow functions; nothing here shuffles."""

"""Column expressions for payloads, features and texts."""

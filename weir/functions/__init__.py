"""Column expressions and the few Python functions that no built-in can express."""

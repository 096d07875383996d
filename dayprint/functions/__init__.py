"""Column expressions: everything here runs inside the JVM, without shuffles."""

"""Pipeline operators: each compiles a configuration into DataFrame operations."""

"""Column builders: pure expressions that Catalyst can fold and push down."""

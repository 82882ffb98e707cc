"""Column functions: no shuffle, no Python worker; all inside whole-stage code generation."""

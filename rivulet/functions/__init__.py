"""Column-expression helpers shared by sources and operators."""

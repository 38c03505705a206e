"""Column expressions and per-task kernels used by the operators."""

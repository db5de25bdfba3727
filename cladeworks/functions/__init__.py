"""Column functions and small numeric kernels shared by operators."""

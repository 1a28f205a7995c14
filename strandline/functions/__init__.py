"""Column functions, numpy kernels over pixel planes and their Arrow functions."""

"""Column functions: Column in, Column out, no jobs and no Python workers."""

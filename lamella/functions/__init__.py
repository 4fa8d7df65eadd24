"""Scalar functions: Column expressions without Python workers."""

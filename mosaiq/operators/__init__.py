"""Operators on arrays: element-wise functions, reductions, reshaping, linear algebra, transforms, distances."""

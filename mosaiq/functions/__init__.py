"""Column functions: element-wise maths, predicates, aggregates; and the types they follow."""

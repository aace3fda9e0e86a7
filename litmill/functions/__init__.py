"""Column functions: keys, names, labels and codes. All are built-in expressions unless a docstring says otherwise."""

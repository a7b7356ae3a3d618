"""Training-data operators: each module holds one operator with a DataFrame-in, DataFrame-out interface."""
